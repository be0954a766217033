"""Pages of service answers, landed as one JSON document per line."""

from pyspark.sql import functions as F

from mailgrid.functions.columns import coalesce_defaults


def read_pages(spark, path):
    """All landed pages in one read; the document is in ``body``."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def flatten_items(pages, item_schema, defaults=None, keep=(), on_bad="FAILFAST"):
    """One row per item, fields taken by name; absent fields become NULL or their default.

    A page that is no JSON document, or has a value of the wrong type, fails the job, unless
    ``on_bad`` is 'PERMISSIVE', which leaves it out; ``split_pages`` hands such pages over.
    ``keep`` names page columns to carry along.
    """
    body = F.from_json("body", _page_schema(item_schema), {"mode": on_bad})
    return _items(pages.select(*keep, body.alias("_page")), defaults, keep)


def split_pages(pages, item_schema, defaults=None, keep=()):
    """(items, rejected): the items of all sound pages as ``flatten_items`` gives them, and the
    damaged pages with the kept columns, their body and the reason.

    A page is damaged if it is missing ('no body'), not a JSON document with the items' types
    ('malformed') or has no list of items ('no items'). None of its items is used, so a repaired
    page can be landed again as a whole.
    """
    schema = f"{_page_schema(item_schema)}, _damage string"
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damage"}
    parsed = pages.select(*keep, "body", F.from_json("body", schema, mode).alias("_page"))
    reason = (
        F.when(F.col("body").isNull(), "no body")
        .when(F.col("_page").isNull() | F.col("_page._damage").isNotNull(), "malformed")
        .when(F.col("_page.items").isNull(), "no items")
    )
    judged = parsed.withColumn("reason", reason)
    rejected = judged.filter(F.col("reason").isNotNull()).select(*keep, "body", "reason")
    return _items(judged.filter(F.col("reason").isNull()), defaults, keep), rejected


def _items(parsed, defaults, keep):
    items = parsed.select(*keep, F.explode(F.col("_page.items")).alias("_item"))
    return coalesce_defaults(items.select(*keep, "_item.*"), defaults or {})


def _page_schema(item_schema):
    return f"items array<struct<{_struct_fields(item_schema)}>>"


def _struct_fields(ddl):
    return ", ".join(
        ": ".join(field.strip().split(" ", 1)) for field in ddl.split(", ")
    )
