"""What JSON records are made of, told by their VARIANT values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: names of fields that hold an id.
ID_FIELD = "(?i)id$|^id|_id"


def schemas(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """(key, n_records, n_schemas, schema, mixed_ids) of records (key, record as variant).

    n_schemas counts the different sets of fields at the top, schema is what all records together need. mixed_ids lists the types of each id field if ids are
    numbers here and texts there, across fields too; else it is null. Null records and those that are no objects count as records only.
    """
    rows = records.select(F.col(key).alias("k"), F.col(record).alias("v"))
    names = F.json_object_keys(F.to_json("v"))  # in order, as a variant keeps them
    whole = rows.groupBy("k").agg(F.count("*").alias("n_records"), F.count_distinct(F.array_join(names, "\0")).alias("n_schemas"), F.schema_of_variant_agg("v").alias("schema"))
    fields = rows.sparkSession.sql("SELECT k, f.key AS name, schema_of_variant(f.value) AS kind FROM {rows}, LATERAL variant_explode(v) f WHERE f.key RLIKE '" + ID_FIELD + "'", rows=rows.filter(names.isNotNull()))
    kinds = fields.filter("kind <> 'VOID'").select("k", "name", F.when(F.col("kind") == "STRING", "texto").otherwise("número").alias("kind")).distinct()
    per_field = kinds.groupBy("k", "name").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(": "), "kinds"))), "; ")
    mixed = per_field.groupBy("k").agg(F.when(F.min("low") != F.max("high"), listed).alias("mixed_ids"))
    return whole.join(mixed, "k", "left").select(F.col("k").alias(key), "n_records", "n_schemas", "schema", "mixed_ids")
