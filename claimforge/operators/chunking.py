"""Page fragments: paragraphs with offsets, tables as text, and packing up to a size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paragraphs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, paragraph, char_start): trimmed paragraphs between blank lines; offsets run over kept ones, two apart."""
    split = texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n")).alias("pos", "raw")).withColumn("paragraph", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).where("paragraph <> ''")
    w = Window.partitionBy(key).orderBy("pos")
    before = F.sum(F.length("paragraph") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return split.select(key, (F.row_number().over(w) - 1).alias("ordinal"), "paragraph", F.coalesce(before, F.lit(0)).cast("int").alias("char_start"))


def table_markdown(rows: Column, page: Column) -> Column:
    """Rows of cells as a text table: header, a rule as wide as the header, body rows that are not blank; under two rows null."""
    cells = F.transform(rows, lambda row: F.array_join(F.transform(row, lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))), " | "))
    head = F.element_at(cells, 1)
    rule = F.array_join(F.transform(F.split(head, r" \| "), lambda _: F.lit("---")), " | ")
    body = F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: F.trim(r) != "")
    shown = F.array_join(F.concat(F.array(head, rule), body), "\n")
    return F.when(F.size(rows) >= 2, F.concat(F.lit("[Table on Page "), page.cast("string"), F.lit("]\n"), shown))


def pack_fragments(fragments: DataFrame, keys: list[str], order: list[str], text: str, limit: int = 2400, any_of: list[str] | None = None, first_of: list[str] | None = None) -> DataFrame:
    """(keys..., chunk_no, n_fragments, chunk_text, char_start, char_end, any_of..., first_of...): fragments of a page packed in order, joined by blank lines.

    A chunk is closed when the next fragment would take it over the limit; a fragment over the limit stays whole. A
    chunk has each of the flags ``any_of`` that a fragment of it has, and the first value of ``first_of`` that is
    neither null nor blank. Chunks count their characters from 0; the only fragment of a page keeps the offsets it came
    with, where it has columns char_start and char_end. The fold runs over the fragments of one page, which is what
    bounds its array.
    """
    flags, firsts = any_of or [], first_of or []
    offsets = [c for c in ("char_start", "char_end") if {"char_start", "char_end"} <= set(fragments.columns)]
    held = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags] + [F.nullif(F.col(c), F.lit("")).alias(c) for c in firsts]
    pages = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t"), *held, *offsets))).alias("_f"))
    fields = [("t", "string"), ("n", "int"), *((c, "boolean") for c in flags), *((c, "string") for c in firsts)]
    kind = ",".join(f"{c}:{t}" for c, t in fields)
    empty = F.struct(F.expr(f"cast(array() as array<struct<{kind}>>)").alias("done"), *(F.lit(None).cast(t).alias(c) for c, t in fields))
    now = lambda acc: F.array(F.struct(*(acc[c].alias(c) for c, _ in fields)))

    def step(acc: Column, f: Column) -> Column:
        t = f["_t"]
        fits = acc["t"].isNotNull() & (F.length(acc["t"]) + 2 + F.length(t) <= limit)
        return F.struct(
            F.when(fits | acc["t"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], now(acc))).alias("done"),
            F.when(fits, F.concat(acc["t"], F.lit("\n\n"), t)).otherwise(t).alias("t"),
            F.when(fits, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
            *((F.when(fits, acc[c] | f[c]).otherwise(f[c])).alias(c) for c in flags),
            *((F.when(fits, F.coalesce(acc[c], f[c])).otherwise(f[c])).alias(c) for c in firsts),
        )

    only = (F.size("_f") == 1) if offsets else F.lit(False)
    kept = [F.when(only, F.col("_f")[0][c]).alias(f"_{c}") for c in offsets]
    packed = pages.select(*keys, *kept, F.aggregate("_f", empty, step, lambda acc: F.concat(acc["done"], now(acc))).alias("_c"))
    packed = packed.select(*keys, *(f"_{c}" for c in offsets), F.posexplode("_c").alias("chunk_no", "_p"))
    start, end = (F.coalesce(f"_{c}", own) if offsets else own for c, own in (("char_start", F.lit(0)), ("char_end", F.length("_p.t"))))
    return packed.select(*keys, "chunk_no", F.col("_p.n").alias("n_fragments"), F.col("_p.t").alias("chunk_text"), start.alias("char_start"), end.alias("char_end"), *(F.col(f"_p.{c}").alias(c) for c in (*flags, *firsts)))


def first_pages_text(fragments: DataFrame, key: str, page: str, order: str, text: str, pages: int = 3) -> DataFrame:
    """(key, first_text): the texts of the first pages that are not blank, in order; keys without any have an empty one."""
    early = (F.col(page) <= pages) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    listed = F.array_sort(F.collect_list(F.when(early, F.struct(page, order, F.col(text).alias("_t")))))
    return fragments.groupBy(key).agg(F.array_join(F.transform(listed, lambda f: f["_t"]), "\n").alias("first_text"))


def visual_pages(pages: DataFrame, text: str, images: str, least: int = 80) -> DataFrame:
    """Pages with pictures and hardly any text, with ``shown``: their text, or a line that stands for a page without any."""
    found = pages.where(needs_vision(F.col(text), F.col(images), least))
    bare = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return found.withColumn("shown", F.when(bare, F.concat(F.lit("[Visual / Chart Page "), F.col("page_number").cast("string"), F.lit("]"))).otherwise(F.col(text)))


def needs_vision(text: Column, images: Column, least: int = 80) -> Column:
    """Pages with pictures and hardly any text."""
    return (F.length(F.coalesce(text, F.lit(""))) < least) & (images > 0)
