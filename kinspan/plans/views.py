"""Record-linkage views over the driver's tables; the same SQL text runs in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.operators import blocking as B
from kinspan.operators.features import REPRESENTATION
from kinspan.operators.records import PROCESSED, blocking_keys, process, representations
from kinspan.sources.staging import staged

#: Columns that true pairs agree in, and those that blocking adds.
TWIN = ("p_name", "p_brand", "p_type")
KEYED = [*[f"key_{x}" for x in "ABCDEF"], "has_addr", "has_addr_num"]

PART_VIEW = """
with b as (select *, cast(substr(p_brand, 7) as int) bn, p_partkey % 3 + 1 k from {part})
select 'source' || k source, 'S' || k || '-' || p_partkey entity_id,
  (case when p_size % 11 = 3 then 'M/s ' else '' end) || p_name || ' ' || p_type || ' ' ||
    (case p_size % 6 when 0 then 'Private Limited' when 1 then 'Pvt. Ltd.' when 2 then 'Inc.'
                     when 3 then 'Corporation' when 4 then 'LLC' else 'Co.' end) business_name,
  case when p_partkey % 30 = 7 then null when p_size % 10 = 4 then 'Suite b, ' || p_type || ' Plaza'
       else (bn * 4 + length(p_type)) || (case when p_size % 4 = 0 then '/' || bn else '' end)
            || ' ' || p_type || ' Road, ' || p_brand || ' ' || (10000 + bn) end business_address,
  case bn % 3 when 0 then (case when p_size % 2 = 0 then 'US' else 'U.S.A.' end)
              when 1 then (case when p_size % 2 = 0 then 'India' else 'Bharat' end)
              else (case when p_size % 2 = 0 then 'France' else 'FRA' end) end country,
  p_name, p_brand, p_type from b
"""

TRUTH_VIEW = """
select a.entity_id source1_entity_id, b.entity_id candidate_entity_id, b.source candidate_source
from {er} a join {er} b on a.p_name = b.p_name and a.p_brand = b.p_brand and a.p_type = b.p_type
where a.source = 'source1' and b.source <> 'source1'
"""


def er_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PART_VIEW.format(part=f"parquet.`{sf_dir}/part.parquet`"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with its processed columns, blocking keys and comparison columns, written once for a state of the part table.

    All queries over entities and pairs read the columns they need of this; the part table is read to prepare it.
    It holds no Indic text, so no Python runs. Entities of one `class` are equal in all but id and source.
    """
    same = F.unhex(F.sha2(F.to_json(F.struct("business_name", "business_address", "country", *TWIN)), 256))
    return staged(spark, "entities", f"{sf_dir}/part.parquet", lambda: representations(blocking_keys(process(B.spread(er_part(spark, sf_dir)), indic=False, carry=TWIN))).withColumn("class", same))


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    er = prepared(spark, sf_dir)
    one = er.filter("source = 'source1'").selectExpr("entity_id source1_entity_id", *TWIN)
    two = er.filter("source <> 'source1'").selectExpr("entity_id candidate_entity_id", "source candidate_source", *TWIN)
    return one.join(two, list(TWIN)).drop(*TWIN)


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select(*PROCESSED)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select(*PROCESSED, *KEYED)


def represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select(*PROCESSED, *REPRESENTATION)
