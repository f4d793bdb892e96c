"""Queries of the problems 5 and 8 to 10, over whole tables and whole texts with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.values import STAND_INS, is_filled_amount, is_filled_text
from reelmill.llm import leakage, mixing, survivor, textstats
from reelmill.session import scratch_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FIELDS = [
    survivor.Bundle("known_for_department", ("known_for_department",), is_filled_text),
    survivor.Bundle("popularity", ("popularity",), is_filled_amount),
    survivor.Bundle("profile_path", ("profile_path",), is_filled_text),
]
NAME = survivor.Bundle("name", ("name", "original_name"), is_filled_text)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = survivor.survivors(table(spark, sf_dir, "people_records"), "id", "record_id", "source_fetched_at", FIELDS, least_rows=2)
    return chosen.select(F.col("k").cast("bigint").alias("person_id"), F.col("bundle").alias("field_name"), F.col("record").cast("bigint").alias("record_id"))


def p5_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per person: both names from one sighting, and a picture that some sighting shows under that name."""
    df = table(spark, sf_dir, "people_records")
    made = survivor.golden_records(df, "id", "record_id", "source_fetched_at", [NAME, *FIELDS], [survivor.Dependency("name", "profile_path")])
    return made.withColumn("id", F.col("id").cast("bigint"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without leaked spans and without documents that are leaks for the most part."""
    return leakage.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held = scratch_table(mixing.sized(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")), "sized")
    return held, scratch_table(mixing.plan(held, table(spark, sf_dir, "mix_targets")), "plan")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of which every token is used as often as allowed and the share isn't reached."""
    return p9_shares(spark, sf_dir).where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents used and how often."""
    held, planned = _mixture(spark, sf_dir)
    return mixing.mix(held, planned)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    held, planned = _mixture(spark, sf_dir)
    return mixing.shares(planned, mixing.mix(held, planned))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.mostly_no_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics of every document."""
    return textstats.text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p10_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of :func:`p10_stats` that SQL can count too."""
    stats = p10_stats(spark, sf_dir)
    return stats.select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("symbol_ratio", 6).alias("symbol_ratio"), F.round("common_share", 6).alias("common_share"))


QUERIES = {f.__name__: f for f in (p5_found, p5_people, p8_found, p8_coverage, p8_cleaned, p9_found, p9_mix, p9_shares, p10_found, p10_stats, p10_words)}

_STAND_IN_SQL = ", ".join("'" + s.replace("'", "''") + "'" for s in ("", *STAND_INS))


def _filled(c: str) -> str:
    if c == "popularity":
        return "coalesce(popularity >= 0 AND NOT isnan(popularity) AND NOT isinf(popularity), false)"
    return f"coalesce(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) NOT IN ({_STAND_IN_SQL}), false)"


def _survivor_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT CAST(id AS BIGINT) AS person_id, '{c}' AS field_name, record_id FROM (SELECT id, record_id, row_number() OVER (PARTITION BY id ORDER BY source_fetched_at DESC NULLS LAST, record_id) AS rn "
        f"FROM people_records WHERE {_filled(c)} AND id IN (SELECT id FROM people_records GROUP BY id HAVING count(*) > 1)) WHERE rn = 1"
        for c in ("known_for_department", "popularity", "profile_path")
    )


def _people_sql() -> str:
    """Every pair of a name and a picture beside it is tried; the greatest sum of times survives."""
    never = survivor.NEVER * 1_000_000
    last = lambda c: f"SELECT id, arg_max({c}, struct_pack(t := t, b := -record_id)) AS {c} FROM r WHERE {_filled(c)} GROUP BY 1"
    return f"""
WITH r AS (SELECT *, coalesce(epoch_us(source_fetched_at), {never}) AS t, {_filled("name")} AND {_filled("original_name")} AS named, {_filled("profile_path")} AS pictured FROM people_records WHERE id IS NOT NULL),
names AS (SELECT id, name, original_name, max(struct_pack(t := t, b := -record_id)) AS x FROM r WHERE named GROUP BY ALL),
pictures AS (SELECT id, profile_path, max(struct_pack(t := t, b := -record_id)) AS y FROM r WHERE pictured GROUP BY ALL),
beside AS (SELECT p.id, p.name, p.original_name, max(struct_pack(t := y.t, b := y.b, v := pictures.profile_path)) AS y FROM (SELECT DISTINCT id, name, original_name, profile_path FROM r WHERE named AND pictured) p JOIN pictures USING (id, profile_path) GROUP BY ALL),
tops AS (SELECT id, max(struct_pack(t := y.t, b := y.b, v := profile_path)) AS y FROM pictures GROUP BY 1),
choices AS (SELECT n.id, n.name, n.original_name, x, coalesce(b.y, t.y) AS y FROM names n LEFT JOIN beside b USING (id, name, original_name) LEFT JOIN tops t ON n.id = t.id),
best AS (SELECT id, arg_max(struct_pack(name := name, original_name := original_name, path := y.v), struct_pack(value := x.t + coalesce(y.t, 0), t := x.t, b := x.b)) AS c FROM choices GROUP BY 1),
departments AS ({last("known_for_department")}), popularities AS ({last("popularity")})
SELECT CAST(i.id AS BIGINT) AS id, c.name AS name, c.original_name AS original_name, known_for_department, popularity, CASE WHEN c IS NULL THEN tops.y.v ELSE c.path END AS profile_path
FROM (SELECT DISTINCT id FROM r WHERE named OR pictured OR {_filled("known_for_department")} OR {_filled("popularity")}) i LEFT JOIN best ON i.id = best.id LEFT JOIN tops ON i.id = tops.id LEFT JOIN departments d ON i.id = d.id LEFT JOIN popularities p ON i.id = p.id"""


SQL = {
    "p5_found": _survivor_sql(),
    "p5_people": _people_sql(),
    # no case hangs on the measure of size, so characters do for tokens
    "p9_found": """
SELECT m.source FROM mix_targets m LEFT JOIN (SELECT source, sum(length(text)) AS n FROM documents GROUP BY source) d ON m.source = d.source
WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(length(text)) FROM documents)""",
    "p10_words": r"""
WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '\p{L}+') AS ws FROM documents WHERE text IS NOT NULL AND length(trim(text, E' \t\n\r')) > 0),
vocabulary AS (SELECT list(DISTINCT lower(word)) AS known FROM common_words WHERE word IS NOT NULL),
counted AS (SELECT doc_id, length(text) AS n_chars, len(ws) AS n_words, list_sum(list_transform(ws, lambda w: length(w))) AS letters,
  len(list_filter(ws, lambda w: list_contains(known, lower(w)))) AS shared,
  len(regexp_extract_all(text, '[^\p{L}\p{N}\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]')) AS symbols FROM cut, vocabulary)
SELECT doc_id, n_words, round(CASE WHEN n_words > 0 THEN letters / n_words::DOUBLE END, 6) AS mean_word_length, round(symbols / n_chars::DOUBLE, 6) AS symbol_ratio,
  round(CASE WHEN n_words > 0 THEN shared / n_words::DOUBLE END, 6) AS common_share FROM counted
UNION ALL SELECT doc_id, 0, NULL, NULL, NULL FROM documents WHERE text IS NULL OR length(trim(text, E' \t\n\r')) = 0""",
}
