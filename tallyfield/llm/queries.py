"""Queries of this subpackage and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from ..session import cut, spread, table
from .bpe import decode_column, encode_column
from .language import document_languages, fit_profiles
from .leakage import passages_in_documents, passages_nearby
from .matching import PLANTED, match_records
from .nearest import nearest_in_time
from .topn import top_n_per_group
from .variants import link_variants, linked_pairs

registry = Registry()


def position(c):
    """A position without outer white space, in upper case, with one name for defences."""
    p = F.upper(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(p.isin("D/ST", "DST"), "DEF").otherwise(p)


P1_SQL = r"""
    WITH a AS (
      SELECT slate_id, pool_row_id, player_key, estimated_fp,
             upper(regexp_replace(pos, '^[\s]+|[\s]+$', '', 'g')) AS p
      FROM slate_pool WHERE pos IS NOT NULL AND estimated_fp IS NOT NULL AND NOT isnan(estimated_fp)),
    b AS (SELECT slate_id, CASE WHEN p IN ('D/ST', 'DST') THEN 'DEF' ELSE p END AS pos, pool_row_id, player_key, estimated_fp FROM a WHERE p <> ''),
    c AS (SELECT *, row_number() OVER (PARTITION BY slate_id, pos, player_key ORDER BY estimated_fp DESC, pool_row_id) AS k FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY slate_id, pos ORDER BY estimated_fp DESC, player_key, pool_row_id) AS place FROM c WHERE k = 1)
"""


def top_players(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    pool = table(spark, sf_dir, "slate_pool").select("slate_id", position(F.col("pos")).alias("pos"), "pool_row_id", "player_key", "estimated_fp")
    return top_n_per_group(pool.where("pos <> ''"), ["slate_id", "pos"], "estimated_fp", "player_key", "pool_row_id", n)


@registry.query("p1_found", P1_SQL + "SELECT slate_id, pos, CAST(place AS INTEGER) AS place, pool_row_id FROM d WHERE place <= 5")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five players with the highest estimate of every slate and position."""
    return top_players(spark, sf_dir).select("slate_id", "pos", "place", "pool_row_id")


@registry.query(
    "p1_top_estimates",
    P1_SQL + "SELECT slate_id, pos, CAST(place AS INTEGER) AS place, pool_row_id, player_key, estimated_fp FROM d WHERE place <= 20",
)
def p1_top_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of every slate and position with their estimates."""
    return top_players(spark, sf_dir, 20).select("slate_id", "pos", "place", "pool_row_id", "player_key", "estimated_fp")


P6_SQL = """
    WITH l AS (SELECT lineup_row_id, player_key, kickoff_utc FROM lineup_rows WHERE player_key IS NOT NULL AND kickoff_utc IS NOT NULL),
    q AS (SELECT quote_id, player_key, kickoff_utc, market_mean FROM market_quotes
          WHERE player_key IS NOT NULL AND kickoff_utc IS NOT NULL AND market_mean IS NOT NULL AND NOT isnan(market_mean)),
    m AS (SELECT lineup_row_id, quote_id, market_mean, abs(epoch_us(l.kickoff_utc) - epoch_us(q.kickoff_utc)) AS gap_us
          FROM l JOIN q ON l.player_key = q.player_key AND q.kickoff_utc BETWEEN l.kickoff_utc - INTERVAL 6 HOUR AND l.kickoff_utc + INTERVAL 6 HOUR),
    b AS (SELECT *, row_number() OVER (PARTITION BY lineup_row_id ORDER BY gap_us, quote_id) AS k FROM m)
"""
SIX_HOURS_US = 6 * 3600 * 1_000_000


def nearest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "market_quotes").where("market_mean is not null and not isnan(market_mean)")
    return nearest_in_time(
        table(spark, sf_dir, "lineup_rows"), quotes, "player_key", "kickoff_utc", "kickoff_utc", "lineup_row_id", "quote_id", SIX_HOURS_US
    )


@registry.query("p6_found", P6_SQL + "SELECT lineup_row_id, quote_id FROM b WHERE k = 1")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest usable quote of every lineup row within six hours."""
    return nearest_quotes(spark, sf_dir).select("lineup_row_id", "quote_id")


@registry.query(
    "p6_market_mean",
    P6_SQL + """
    SELECT r.lineup_row_id, b.quote_id, b.market_mean, b.gap_us FROM lineup_rows r LEFT JOIN (SELECT * FROM b WHERE k = 1) b USING (lineup_row_id)
    """,
)
def p6_market_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineup row with the market mean and the distance of its quote, null where none is near."""
    found = nearest_quotes(spark, sf_dir).join(table(spark, sf_dir, "market_quotes").select("quote_id", "market_mean"), "quote_id")
    return table(spark, sf_dir, "lineup_rows").select("lineup_row_id").join(found, "lineup_row_id", "left").select("lineup_row_id", "quote_id", "market_mean", "gap_us")


@registry.query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", ["doc_id"])


@registry.query("p7_decoded", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again from their ids: an exact round trip."""
    return decode_column(p7_ids(spark, sf_dir), "ids", ["doc_id"])


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages_in_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "passage", 12)


@registry.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of an evaluation passage."""
    return leaks(spark, sf_dir).select("doc_id", "item_id")


@registry.query("p8_nearby")
def p8_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which six of a passage's eight rarest words lie within sixty words, in any order."""
    return passages_nearby(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "passage")


@registry.query("p8_longest_runs")
def p8_longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks with the number of consecutive words and its share of the passage's words."""
    n = F.size(F.regexp_extract_all("passage", F.lit(r"(?U)([\p{L}\p{N}]+)"), 1))
    items = table(spark, sf_dir, "eval_items").select("item_id", "benchmark", n.alias("n_words"))
    found = leaks(spark, sf_dir).join(items, "item_id")
    return found.select("doc_id", "item_id", "benchmark", F.col("longest").alias("n_run"), F.round(F.col("longest") / F.col("n_words"), 4).alias("share"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_profiles(table(spark, sf_dir, "lang_samples"), "lang", "text")
    return document_languages(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), "doc_id", "text", "lang", model)


@registry.query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong, and the paragraphs of mixed documents."""
    found = languages(spark, sf_dir).where("lang_code is not null and ((seg_no = -1 and not (labelled <=> lang_code)) or (seg_no >= 0 and mixed))")
    return found.select("doc_id", "seg_no", "lang_code")


@registry.query("p9_confidence")
def p9_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and every paragraph."""
    return languages(spark, sf_dir).select("doc_id", "seg_no", "lang_code", F.round("confidence", 4).alias("confidence"), "n_words", "mixed")


def roster_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_variants(spread(table(spark, sf_dir, "roster_entries").select("entry_id", "player", "pos", "team")), table(spark, sf_dir, "teams"), "entry_id", "player", "pos", "team")


@registry.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two roster entries that mean the same player or team unit."""
    return linked_pairs(roster_entities(spark, sf_dir), "entry_id", "entry_id_a", "entry_id_b")


@registry.query("p2_entities")
def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry with its entity and the number of entries of that entity."""
    found = cut(roster_entities(spark, sf_dir))
    sizes = found.groupBy("entity").agg(F.count("*").alias("n_entries"))
    return found.join(sizes, "entity").select("entry_id", "entity", "n_entries")

#: Positions by their numbers in the second feed. Fixed values.
POSITION_IDS = {1: "QB", 2: "RB", 3: "WR", 4: "TE", 5: "K", 16: "DEF"}


def feed_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    teams = table(spark, sf_dir, "teams")
    left = table(spark, sf_dir, "salary_feed").select("salary_row_id", "player", "pos", "team")
    names = F.create_map(*[x for k, v in POSITION_IDS.items() for x in (F.lit(k), F.lit(v))])
    codes = teams.select(F.col("espn_pro_team_id").alias("pro_team_id"), "team_code")
    feed = table(spark, sf_dir, "espn_feed").join(codes, "pro_team_id", "left")
    return left, feed.select("espn_row_id", "full_name", F.element_at(names, F.col("default_position_id")).alias("pos"), F.col("team_code").alias("team")), teams


def feed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with rule and confidence; the labels are copies of salary rows, as the feeds bring none."""
    return match_records(*feed_records(spark, sf_dir), planted=PLANTED)


@registry.query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the two feeds that describe the same player or team unit."""
    return feed_matches(spark, sf_dir).select(F.col("a").alias("salary_row_id"), F.col("b").alias("espn_row_id"))


@registry.query("p3_confidence")
def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with the rule that found each and that rule's smoothed precision."""
    return feed_matches(spark, sf_dir).select(F.col("a").alias("salary_row_id"), F.col("b").alias("espn_row_id"), "rule", F.round("confidence", 4).alias("confidence"))
