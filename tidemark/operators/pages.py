"""Pages to ordered blocks with their section, tables to rows and row groups, blocks to chunks, by SQL alone.

HTML is cut into tags and texts where it is; a running count of block tags numbers the blocks, a table's
rows are one block with a line for each row, and the headings before a block are its section. Chunks
pack the words of neighbouring blocks of a section greedily, and the rows of a table under its repeated
first row; a fold over the sizes of one page's parts says which packet each is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags that begin a block of a kind, other tags that end one, and entities.
KINDS = {"title": "TITLE", **{f"h{i}": "HEADING" for i in range(1, 7)}, "p": "PROSE", "li": "LIST", "tr": "TABLE"}
ENDS = ["html", "head", "body", "header", "footer", "main", "nav", "section", "article", "aside", "div", "ul", "ol", "table", "thead", "tbody", "caption", "blockquote", "pre", "form"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
SKIPPED = [r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>"]
CELL, LEVELS, JOIN = "\x1f", 6, " > "


def _plain(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _cells(text: Column) -> Column:
    """The cells of a row joined; what stands before the first one goes."""
    return F.array_join(F.transform(F.slice(F.split(text, CELL), 2, 1 << 20), _plain), " | ")


def blocks(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, block, kind, level, section, text): titles, headings, prose, list items and whole tables, in order.

    Null and empty pages have no block; an unclosed tag ends with the page.
    """
    bare = F.coalesce(html, F.lit(""))
    for pattern in SKIPPED:
        bare = F.regexp_replace(bare, pattern, "")
    parts = pages.select(F.col(id), F.posexplode(F.regexp_extract_all(bare, F.lit("<[^>]*>|[^<]+"), F.lit(0))).alias("at", "part"))
    tag, opens = F.lower(F.regexp_extract("part", "^</?([a-zA-Z0-9]+)", 1)), ~F.col("part").startswith("</")
    rows = parts.withColumns({"tag": tag, "opens": opens, "is_tag": F.col("part").startswith("<")})
    begins, table = F.col("tag").isin(*KINDS, *ENDS), F.col("tag") == "table"
    line = Window.partitionBy(id).orderBy("at")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = rows.withColumn("segment", F.sum(F.when(begins, 1).otherwise(0)).over(line)).withColumn("table", F.sum(F.when(table & F.col("opens"), 1).otherwise(0)).over(line)).withColumn("inside", F.sum(F.when(table, F.when(F.col("opens"), 1).otherwise(-1)).otherwise(0)).over(line) > 0)
    word = F.when(~F.col("is_tag"), F.col("part")).when(F.col("tag").isin("td", "th") & F.col("opens"), CELL).when(F.col("tag") == "br", " ").otherwise("")
    first = F.min_by(F.when(begins & F.col("opens"), F.col("tag")), "at")
    segments = rows.groupBy(id, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", word.alias("w")))), lambda x: x["w"]), "").alias("raw"), first.alias("tag"), F.max("table").alias("table"), F.bool_and("inside").alias("inside"))
    kind = F.coalesce(F.try_element_at(kinds, F.col("tag")), F.lit("PROSE"))
    kind = F.when((kind == "TABLE") & ~F.col("inside"), "PROSE").otherwise(kind)
    segments = segments.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "TABLE", _cells(F.col("raw"))).otherwise(_plain(F.replace(F.col("raw"), F.lit(CELL), F.lit(" "))))).where("text <> ''")
    level = F.when(F.col("kind") == "HEADING", F.substring("tag", 2, 1).cast("int"))
    whole = F.when(F.col("kind") == "TABLE", -F.col("table")).otherwise(F.col("segment"))
    joined = segments.withColumn("level", level).groupBy(id, "kind", whole.alias("key")).agg(
        F.min("segment").alias("segment"), F.max("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    return _sections(joined, id).select(id, "block", "kind", "level", "section", "text")


def _sections(rows: DataFrame, id: str) -> DataFrame:
    """Blocks numbered from 0, each with the headings that it stands under."""
    line = Window.partitionBy(id).orderBy("segment")
    so_far = line.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumns({f"h{i}": F.last(F.when(F.col("level") == i, F.struct("segment", "text")), ignorenulls=True).over(so_far) for i in range(1, LEVELS + 1)})
    names = []
    for i in range(1, LEVELS + 1):
        above = [F.coalesce(F.col(f"h{j}.segment"), F.lit(-1)) for j in range(1, i)]
        valid = F.col(f"h{i}").isNotNull() if not above else F.col(f"h{i}.segment") > (F.greatest(*above) if len(above) > 1 else above[0])
        names.append(F.when(valid, F.col(f"h{i}.text")))
    return seen.withColumn("section", F.concat_ws(JOIN, *names)).withColumn("block", (F.row_number().over(line) - 1).cast("int"))


def greedy(sizes: Column, most: int, most_items: int = 1 << 30) -> Column:
    """For an array of sizes the packet of each: a packet takes items while their sizes sum to ``most`` at most.

    An item that is larger than that is a packet of its own.
    """
    zero = F.struct(F.lit(0).alias("packet"), F.lit(0).cast("bigint").alias("held"), F.lit(0).alias("items"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        x = x.cast("bigint")
        fresh = (a["items"] > 0) & ((a["held"] + x > most) | (a["items"] == most_items))
        packet = F.when(fresh, a["packet"] + 1).otherwise(a["packet"])
        return F.struct(packet.alias("packet"), F.when(fresh, x).otherwise(a["held"] + x).alias("held"), F.when(fresh, 1).otherwise(a["items"] + 1).alias("items"), F.concat(a["out"], F.array(packet)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda a: a["out"])


def packed(rows: DataFrame, by: list[str], order: list[str], size: str, most: int, most_items: int = 1 << 30) -> DataFrame:
    """The rows with the ``packet`` of each in its group, filled greedily in order; a group is a document or a part of one."""
    item = F.struct(*order, F.col(size).alias("size_"), F.struct(*[c for c in rows.columns if c not in by]).alias("row"))
    groups = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    placed = groups.select(*by, F.explode(F.arrays_zip(F.col("items.row").alias("row"), greedy(F.col("items.size_"), most, most_items).alias("packet"))).alias("x"))
    return placed.select(*by, "x.row.*", "x.packet")


def chunks(found: DataFrame, id: str = "page_id", most_words: int = 120) -> DataFrame:
    """(id, chunk, kind, section, text) of blocks: prose and lists of a section packed, tables by groups of rows.

    Titles and headings begin a section and are no chunks; a block of more words is cut.
    """
    line = Window.partitionBy(id).orderBy("block")
    body = F.when(F.col("kind").isin("PROSE", "LIST"), "PROSE").otherwise(F.col("kind"))
    rows = found.withColumn("kind", body)
    new = ~(F.col("kind").eqNullSafe(F.lag("kind").over(line)) & F.col("section").eqNullSafe(F.lag("section").over(line)) & (F.col("kind") == "PROSE"))
    rows = rows.withColumn("new", new).withColumn("run", F.sum(F.when(F.col("new"), 1).otherwise(0)).over(line)).where("kind in ('PROSE', 'TABLE')")
    words = F.split("text", " ")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / most_words)), lambda i: F.array_join(F.slice(words, i * most_words + 1, F.lit(most_words)), " "))
    lines = F.split("text", "\n")
    rest = F.when(F.size(lines) > 1, F.slice(lines, 2, 1 << 20)).otherwise(F.array(F.lit("")))
    table = F.col("kind") == "TABLE"
    parts = rows.select(id, "run", "kind", "section", "block", F.when(table, F.get(lines, F.lit(0))).alias("head"), F.posexplode(F.when(table, rest).otherwise(cuts)).alias("part", "text"))
    parts = parts.withColumn("n", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))))
    placed = packed(parts, [id, "run"], ["block", "part"], "n", most_words)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), lambda x: x["text"])
    made = placed.groupBy(id, "run", "packet").agg(F.first("kind").alias("kind"), F.first("section").alias("section"), F.first("head").alias("head"), texts.alias("texts"))
    text = F.when(F.col("kind") == "TABLE", F.rtrim(F.array_join(F.concat(F.array("head"), "texts"), "\n"), F.lit("\n"))).otherwise(F.array_join("texts", " "))
    number = (F.row_number().over(Window.partitionBy(id).orderBy("run", "packet")) - 1).cast("int")
    return made.select(id, number.alias("chunk"), "kind", "section", text.alias("text"))

