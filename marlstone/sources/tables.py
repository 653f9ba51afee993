"""Readers: provided tables, and the record formats of a catalog (JSON lines, CSV with aliases, webhook payloads)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRODUCT = (
    "product_id string, sku string, name string, category string, brand string, short_description string, full_description string, status string, updated_at string, price double, "
    "currency string, stock int, tags array<string>, attributes map<string,string>, size_stock map<string,int>, include_in_rag boolean"
)
CHUNK = (
    "chunk_id string, document_id string, act_title string, chunk_scope string, chunk_variant string, source_node_id string, source_node_type string, text string, normalized_text string, "
    "token_count int, page_start int, page_end int, page_numbers array<int>, section_number string, subsection_number string, citability_label string, label string, title string, "
    "linked_node_ids array<string>, metadata map<string,string>"
)
NODE = "node_id string, document_id string, act_title string, node_type string, text string, normalized_text string, page_start int, page_end int, parent_id string, label string, title string, path_ids array<string>"
LINK = "source_node_id string, target_node_id string, relation string"
EVENT = "event string, session_id string, timestamp string, question string, product_ids array<string>, intent string, confidence double, order_id string, total_amount double, reason string"
VECTOR = "record_id string, vector array<float>, metadata map<string,string>, text string, namespace string"

#: Column: the names under which a till's export may hold it, first found wins.
CSV_ALIASES = {
    "product_id": ("product_id", "id"), "sku": ("sku", "SKU"), "name": ("name", "product_name"), "price": ("price",), "stock": ("stock", "quantity"), "category": ("category",),
    "brand": ("brand",), "currency": ("currency",), "status": ("status",), "tags": ("tags",), "updated_at": ("updated_at",),
}
CSV_ATTRIBUTES = ("category_key", "color", "color_family", "size", "fabric", "occasion")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines with a fixed schema. Strict: a malformed line fails the read; else it is dropped. Blank lines never count."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_documents(spark: SparkSession, root: str, part: str, schema: str) -> DataFrame:
    """``root``/<document>/``part`` of every document folder, with the folder's name."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/*/{part}")
    return rows.withColumn("document_folder", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+/[^/]+$", 1))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of whole-file graph documents."""
    whole = spark.read.schema(f"nodes array<struct<{NODE}>>, links array<struct<{LINK}>>").json(path, multiLine=True)
    return whole.select(F.inline("nodes")), whole.select(F.inline("links"))


def last_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key by ``order``. An aggregate, so a hot key is combined before it is moved."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(last).select("_row.*")


def merge_sources(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of several inputs; of one key the later input's row stays."""
    numbered = [f.withColumn("_from", F.lit(i)) for i, f in enumerate(frames)]
    rows = numbered[0]
    for more in numbered[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return last_wins(rows, [key], ["_from"]).drop("_from")


def read_products_csv(spark: SparkSession, path: str) -> DataFrame:
    """A till's CSV export as products: aliases resolved, bad numbers 0, tags split, attribute columns in a map; rows without a key dropped."""
    raw = spark.read.csv(path, header=True)
    named = {c: [a for a in aliases if a in raw.columns] for c, aliases in CSV_ALIASES.items()}
    value = {c: F.coalesce(*[F.nullif(F.trim(a), F.lit("")) for a in found]) if found else F.lit(None).cast("string") for c, found in named.items()}
    pairs = [F.struct(F.lit(a).alias("key"), F.nullif(F.trim(a), F.lit("")).alias("value")) for a in CSV_ATTRIBUTES if a in raw.columns]
    attributes = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")
    rows = raw.select(
        *[value[c].alias(c) for c in ("product_id", "sku", "name", "category", "brand", "currency", "status", "updated_at")],
        F.coalesce(value["price"].try_cast("double"), F.lit(0.0)).alias("price"),
        F.coalesce(value["stock"].try_cast("double").cast("int"), F.lit(0)).alias("stock"),
        F.filter(F.transform(F.split(F.coalesce(value["tags"], F.lit("")), ","), lambda x: F.trim(x)), lambda t: t != "").alias("tags"),
        attributes.alias("attributes"),
    )
    return rows.where("product_id IS NOT NULL AND sku IS NOT NULL AND name IS NOT NULL")


def read_webhook(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row for each item of JSON payloads {event, items}."""
    schema = "event string, items array<struct<sku string, stock int, price double, status string, updated_at string>>"
    return payloads.select(F.from_json(column, schema).alias("p")).select(F.col("p.event").alias("event"), F.inline("p.items"))


def tail(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of a log, in its order: a distributed top-n, then a sort of n rows."""
    return rows.orderBy(*[F.desc(o) for o in order]).limit(n).orderBy(*order)


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, kept in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
