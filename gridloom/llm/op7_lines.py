"""Line dedup by distinct-site spread: cross-site boilerplate lines go, the rest of each document stays.

1. Lines (between newlines, trimmed of white space at both ends, not empty) are hashed; one aggregation finds the
   line hashes seen at more than one site (its least and greatest site hash differ), combining within each task first.
2. All occurrences of those go into HyperLogLog sketches of their sites, one a line hash, built within each task and
   merged by aggregation.
3. A line spreads if the sketch's lower bound reaches min_sites, and doesn't if its upper bound stays below (three
   standard errors); only lines in between have their (line, site) pairs made distinct and counted.
4. A line spreading over at least min_sites sites is boilerplate. It is removed wherever it stands, unless more than
   half of the characters of a document's lines stand in boilerplate lines: such a document is a copy, or nearly, of
   what stands elsewhere, removal would leave scraps of it, and near-duplicate removal is what judges it.
Only flagged positions travel to the documents; texts are cut and rebuilt natively, in time linear in their lines. Lines
that stand in a large share of the documents are broadcast (join_hot).

Cases: a null text has no lines and stays null (kept digest of nothing); an empty text stays empty; a null site is a
site of its own; a repeated line counts once for each site; repeated rows are treated alike, and rows that share a
doc_id but not their text each by their own; the lines of rows with a null doc_id count, but stay; tables may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import FEWEST, drop, join_hot, table

MIN_SITES = 5
LG_K = 11
#: Three relative standard errors of an estimate with 2**11 registers (1.04 / sqrt(2**11) each).
MARGIN = 3 * 1.04 / (2**LG_K) ** 0.5
#: Pairs of a line and a site (16 bytes each) in a file of the scratch table of occurrences.
FILE_PAIRS = 100_000


def _exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, site, pos, h, size): hashed non-empty lines and sites; whole tells the texts of a doc_id apart."""
    site = F.xxhash64(F.coalesce("source", F.lit("\u0000"))).alias("site")
    lines = docs.select("doc_id", F.xxhash64("text").alias("whole"), site, F.posexplode(F.expr("split(text, '\\n', -1)")).alias("pos", "x"))
    lines = lines.select("doc_id", "whole", "site", "pos", F.expr("trim(BOTH ' \\t\\r' FROM x)").alias("x")).where("x <> ''")
    return lines.select("doc_id", "whole", "site", "pos", F.xxhash64("x").alias("h"), F.length("x").alias("size"))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, sites, n): the hashes of the lines that stand at min_sites sites or more, and how often; sites may be an estimate."""
    lines = _exploded(docs).select("h", "site")
    many = table(lines.groupBy("h").agg(F.min("site").alias("lo"), F.max("site").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("h", "n"))
    most, all_of = many.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    several = table(join_hot(lines, many, "h", "n").select("h", "site").repartition(max(FEWEST, -(-all_of // FILE_PAIRS))))
    sketched = several.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("*").alias("n"))
    sketched = table(sketched.select("h", F.hll_sketch_estimate("sketch").alias("sites"), "n"), rows=most)
    sure = sketched.where(F.col("sites") * (1 - MARGIN) >= min_sites)
    near = sketched.where((F.col("sites") * (1 - MARGIN) < min_sites) & (F.ceil(F.col("sites") * (1 + MARGIN)) >= min_sites)).select("h", "n")
    exact = join_hot(several, near, "h", "n").distinct().groupBy("h", "n").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    out = table(sure.unionByName(exact), rows=most)
    drop(many, several, sketched)
    return out


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of docs with the boilerplate lines taken out of text, then the counts of lines and of removed lines
    (long) under the names given; a column of docs with such a name gives way."""
    keyed = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))
    flagged = join_hot(_exploded(keyed).select("doc_id", "whole", "pos", "h", "size"), spread_lines(keyed, min_sites).select("h", "n"), "h", "n")
    gone = flagged.groupBy("doc_id", "whole").agg(F.collect_set(F.struct("pos", "size")).alias("gone"))
    others = F.struct(*[F.col(c) for c in docs.columns if c not in ("text", *counts)])
    packed = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), others.alias("row"))
    packed = packed.select("doc_id", F.xxhash64("text").alias("whole"), F.expr("split(text, '\\n', -1)").alias("lines"), "row")
    met = packed.join(gone, ["doc_id", "whole"], "left")
    trimmed = "transform(lines, x -> trim(BOTH ' \\t\\r' FROM x))"
    sized = met.withColumn("n", F.expr(f"cast(coalesce(size(filter({trimmed}, x -> x <> '')), 0) AS long)"))
    sized = sized.withColumn("chars", F.expr(f"aggregate({trimmed}, 0L, (t, x) -> t + length(x))")).withColumn("shared", F.expr("aggregate(gone, 0L, (t, x) -> t + x.size)"))
    cut = sized.withColumn("gone", F.expr("CASE WHEN shared * 2 <= chars THEN gone.pos END"))
    kept = "array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> get(lines, i)), '\n')"
    text = F.expr(f"CASE WHEN gone IS NULL THEN array_join(lines, '\n') ELSE {kept} END")
    own = [(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in counts]
    return cut.select(*own, F.col("n").alias(counts[0]), F.expr("cast(coalesce(size(gone), 0) AS long)").alias(counts[1]))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
trimmed AS (SELECT doc_id, site, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
spread AS (SELECT line FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (SELECT t.*, t.line <> '' AS is_line, s.line IS NOT NULL AS gone FROM trimmed t LEFT JOIN spread s ON s.line = t.line),
docs AS (SELECT doc_id, count(*) FILTER (is_line) AS n_lines, count(*) FILTER (gone) AS n_gone, sum(length(line)) AS chars, sum(length(line)) FILTER (gone) AS shared,
  string_agg(raw, chr(10) ORDER BY pos) AS whole, string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone) AS cut FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(CASE WHEN shared * 2 > chars THEN 0 ELSE coalesce(n_gone, 0) END AS BIGINT) AS n_removed,
  sha256(CASE WHEN n_gone > 0 AND shared * 2 <= chars THEN coalesce(cut, '') ELSE coalesce(whole, '') END) AS kept_sha256
FROM documents d LEFT JOIN docs USING (doc_id)
"""
