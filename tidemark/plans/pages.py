"""Pages to blocks, chunks and packets. Oracles count tags by windows and fold packets by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pages
from tidemark.plans.registry import query
from tidemark.session import table

MOST = 120

_TAGS = ", ".join(f"'{t}'" for t in [*pages.KINDS, *pages.ENDS])
_KIND = "CASE tag WHEN 'title' THEN 'TITLE' WHEN 'p' THEN 'PROSE' WHEN 'li' THEN 'LIST' WHEN 'tr' THEN CASE WHEN inside THEN 'TABLE' ELSE 'PROSE' END ELSE CASE WHEN tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN 'HEADING' ELSE 'PROSE' END END"


def _plain(text: str) -> str:
    for name, char in pages.ENTITIES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def _bare(text: str) -> str:
    for pattern in pages.SKIPPED:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    return text


_PATHS = ", ".join(f"last_value(CASE WHEN level = {i} THEN segment END IGNORE NULLS) OVER w AS s{i}, last_value(CASE WHEN level = {i} THEN text END IGNORE NULLS) OVER w AS t{i}" for i in range(1, 7))
_UNDER = ", ".join(f"CASE WHEN s{i} > greatest(-1{''.join(f', coalesce(s{j}, -1)' for j in range(1, i))}) THEN t{i} END" for i in range(1, 7))
_BLOCKS = f"""
    src AS (SELECT page_id, regexp_extract_all({_bare("coalesce(html, '')")}, '<[^>]*>|[^<]+') AS parts FROM pages), tok AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS part FROM src),
    tag AS (SELECT page_id, pos, part, lower(regexp_extract(part, '^</?([a-zA-Z0-9]+)', 1)) AS tag, part NOT LIKE '</%' AS opens FROM tok),
    seg AS (SELECT *, tag IN ({_TAGS}) AS begins, sum(CASE WHEN tag IN ({_TAGS}) THEN 1 ELSE 0 END) OVER l AS segment, sum(CASE WHEN tag = 'table' AND opens THEN 1 ELSE 0 END) OVER l AS tab, sum(CASE WHEN tag = 'table' THEN CASE WHEN opens THEN 1 ELSE -1 END ELSE 0 END) OVER l > 0 AS inside FROM tag WINDOW l AS (PARTITION BY page_id ORDER BY pos)),
    raw AS (SELECT page_id, segment, string_agg(CASE WHEN part NOT LIKE '<%' THEN part WHEN tag IN ('td', 'th') AND opens THEN chr(31) WHEN tag = 'br' THEN ' ' ELSE '' END, '' ORDER BY pos) AS raw, min_by(tag, pos) FILTER (WHERE begins AND opens) AS tag, max(tab) AS tab, bool_and(inside) AS inside FROM seg GROUP BY 1, 2),
    txt AS (SELECT page_id, segment, tab, {_KIND} AS kind, CASE WHEN tag LIKE 'h_' AND tag <> 'hr' THEN CAST(tag[2:2] AS int) END AS level, CASE WHEN {_KIND} = 'TABLE' THEN array_to_string(list_transform(string_split(raw, chr(31))[2:], lambda c: {_plain('c')}), ' | ') ELSE {_plain("replace(raw, chr(31), ' ')")} END AS text FROM raw),
    blk AS (SELECT page_id, kind, min(segment) AS segment, max(level) AS level, string_agg(text, chr(10) ORDER BY segment) AS text FROM txt WHERE text <> '' GROUP BY page_id, kind, CASE WHEN kind = 'TABLE' THEN -tab ELSE segment END),
    pth AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY segment) - 1 AS block, {_PATHS} FROM blk WINDOW w AS (PARTITION BY page_id ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    blocks AS (SELECT page_id, block, kind, level, concat_ws(' > ', {_UNDER}) AS section, text FROM pth)"""


@query(f"WITH {_BLOCKS} SELECT page_id, CAST(block AS int) AS block, kind, section, text FROM blocks")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered blocks of each page with their section."""
    return pages.blocks(table(spark, sf_dir, "pages")).drop("level")


@query(f"""
    WITH RECURSIVE {_BLOCKS}, body AS (SELECT page_id, block, CASE WHEN kind = 'LIST' THEN 'PROSE' ELSE kind END AS kind, section, text FROM blocks),
    chg AS (SELECT *, CASE WHEN kind = 'PROSE' AND lag(kind) OVER b = kind AND lag(section) OVER b = section THEN 0 ELSE 1 END AS fresh FROM body WINDOW b AS (PARTITION BY page_id ORDER BY block)), run AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY block) AS run FROM chg),
    wrd AS (SELECT page_id, run, kind, section, block, string_split(text, ' ') AS w FROM run WHERE kind = 'PROSE'), prt AS (SELECT page_id, run, kind, section, block, k, w[k * {MOST} + 1 : (k + 1) * {MOST}] AS w FROM (SELECT *, unnest(range(0, (len(w) - 1) // {MOST} + 1)) AS k FROM wrd) u),
    num AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY page_id, run ORDER BY block, k) AS i FROM prt),
    fold AS (SELECT page_id, run, i, n AS held, 0 AS packet FROM num WHERE i = 1 UNION ALL SELECT num.page_id, num.run, num.i, CASE WHEN held + n > {MOST} THEN n ELSE held + n END, CASE WHEN held + n > {MOST} THEN packet + 1 ELSE packet END FROM fold JOIN num ON num.page_id = fold.page_id AND num.run = fold.run AND num.i = fold.i + 1),
    chk AS (SELECT page_id, run, packet, any_value(section) AS section, string_agg(array_to_string(w, ' '), ' ' ORDER BY num.i) AS text FROM num JOIN fold USING (page_id, run, i) GROUP BY 1, 2, 3)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY run, packet) - 1 AS int) AS chunk, 'PROSE' AS kind, section, text FROM chk""")
def structured_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each page's sections (its pages have no tables; tests have some)."""
    return pages.chunks(pages.blocks(table(spark, sf_dir, "pages")), "page_id", MOST)


@query("""
    WITH RECURSIVE t AS (SELECT conv_id, turn, len(string_split(text, ' ')) AS n_words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    f AS (SELECT conv_id, turn, n_words, i, n_words AS held, 1 AS items, 0 AS packet FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.turn, t.n_words, t.i, CASE WHEN items = 4 OR held + t.n_words > 200 THEN t.n_words ELSE held + t.n_words END, CASE WHEN items = 4 OR held + t.n_words > 200 THEN 1 ELSE items + 1 END,
      CASE WHEN items = 4 OR held + t.n_words > 200 THEN packet + 1 ELSE packet END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
    SELECT conv_id, turn, n_words, CAST(packet AS int) AS packet FROM f""")
def source_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation packed in order: 200 words and four turns at most."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("bigint").alias("n_words"))
    return pages.packed(turns, ["conv_id"], ["turn"], "n_words", 200, 4)
