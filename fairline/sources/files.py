"""Readers and sinks. Schemas are explicit; a mistyped field becomes null, it never drops or aborts a row
unless the caller asks for the strict form."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.functions import prices, times
from fairline.functions.lines import grid_or_null, on_grid
from fairline.functions.reasons import first_reason
from fairline.session import ensure_checkpoint_dir

# Required columns of the multi-league file.
LEAGUE_FILE = (
    "Division", "MatchDate", "HomeTeam", "AwayTeam", "FTHome", "FTAway", "OddHome", "OddDraw", "OddAway",
    "Over25", "Under25", "HandiSize", "HandiHome", "HandiAway",
)


def scratch(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, reachable by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"


def read_text_csv(
    spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8", multi_line: bool = False
) -> DataFrame:
    """All-string CSV scan with a header; numbers are cast later with try_cast.

    The reader strips a byte-order mark. Files in windows-1252 are listed apart and read with that encoding
    (needs spark.sql.legacy.javaCharsets). `multi_line` is for quoted line breaks only: such files do not split.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(
        path, header=True, schema=schema, encoding=encoding, enforceSchema=False, multiLine=multi_line, escape='"'
    )


def _cp1252() -> tuple[str, str, list[str]]:
    """C1 letters as windows-1252 shows them, and the bytes (hex) that it does not know."""
    src, dst, unknown = "", "", []
    for b in range(0x80, 0xA0):
        try:
            dst += bytes([b]).decode("cp1252")
            src += chr(b)
        except UnicodeDecodeError:
            unknown.append(f"{b:02x}")
    return src, dst, unknown


def _fits(raw: Column) -> tuple[Column, Column]:
    """Whether bytes are valid utf-8, and whether they hold one that cp1252 does not know."""
    odd = F.lit(False)
    for b in _cp1252()[2]:
        odd = odd | F.contains(raw, F.unhex(F.lit(b)))
    return F.is_valid_utf8(raw.cast("string")), odd


def _encoding(utf8: Column, odd: Column) -> Column:
    """The first of utf-8, cp1252 and latin-1 that fits."""
    return F.when(utf8, "utf-8").when(odd, "latin-1").otherwise("cp1252")


def _decoded(raw: Column, encoding: Column) -> Column:
    src, dst, _ = _cp1252()
    single = F.decode(raw, "ISO-8859-1")
    return F.when(encoding == "utf-8", raw.cast("string")).when(encoding == "cp1252", F.translate(single, src, dst)).otherwise(single)


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, text of season-sized files: the first of utf-8, cp1252 and latin-1 that fits the whole file.

    Each file is read once; a leading byte-order mark goes. Larger files belong in read_encoded_csv, which splits them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "content", _encoding(*_fits(F.col("content"))).alias("encoding"))
    text = F.regexp_replace(_decoded(F.col("content"), F.col("encoding")), "^\ufeff", "")
    return files.select("path", "encoding", F.when(F.col("encoding") == "utf-8", text).otherwise(_decoded(F.col("content"), F.col("encoding"))).alias("text"))


_CELL = r',(?:"((?:[^"]|"")*)"|([^,"]*))'


def read_encoded_csv(spark: SparkSession, path: str, columns: dict[str, Sequence[str]]) -> DataFrame:
    """path, encoding and the columns as text, from files in different encodings and with their own headers.

    columns: name -> the headers it may have, the first that a file has counts. Cells that are missing or empty are null;
    a quoted cell may hold commas and doubled quotes, but no line break. Blank lines are skipped. Files are read by lines
    and split as the text reader splits them (a byte-order mark at the start goes with any encoding): line breaks have the
    same bytes in all three encodings, so a file is valid utf-8 if all its lines are. What is broadcast is one row a file.
    """
    def cells(line: Column) -> Column:
        line = F.concat(F.lit(","), line)  # every cell begins with a comma
        quoted, plain = F.regexp_extract_all(line, F.lit(_CELL), 1), F.regexp_extract_all(line, F.lit(_CELL), 2)
        return F.transform(F.arrays_zip(quoted.alias("q"), plain.alias("p")), lambda x: F.when(x["q"] != "", F.replace(x["q"], F.lit('""'), F.lit('"'))).otherwise(F.trim(x["p"])))

    text = spark.read.option("recursiveFileLookup", "true").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw")).filter(F.trim(F.col("raw").cast("string")) != "")
    utf8, odd = _fits(F.col("raw"))
    first = F.min_by("raw", F.struct("block", "at"))  # a block of a file is read in order by one task
    heads = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("path").agg(_encoding(F.bool_and(utf8), F.bool_or(odd)).alias("encoding"), first.alias("first"))
    heads = heads.withColumn("head", cells(_decoded(F.col("first"), F.col("encoding"))))
    placed = lines.select("path", "raw").join(F.broadcast(heads), "path")
    # One line of those equal to the header is the header; which of them does not matter.
    again = placed.filter(F.col("raw") == F.col("first")).groupBy("path", "encoding", "first", "head").agg(F.count("*").alias("n")).filter("n > 1")
    again = again.select("path", "encoding", "head", F.col("first").alias("raw"), F.explode(F.sequence(F.lit(2), F.col("n"))).alias("_at")).drop("_at")
    rows = placed.filter(F.col("raw") != F.col("first")).select("path", "encoding", "head", "raw").unionByName(again)
    rows = rows.withColumn("cells", cells(_decoded(F.col("raw"), F.col("encoding"))))

    def pick(names: Sequence[str]) -> Column:
        at = F.coalesce(*[F.nullif(F.array_position("head", n), F.lit(0)) for n in names])
        value = F.get("cells", (at - 1).cast("int"))
        return F.when(value != "", value)

    return rows.select("path", "encoding", *[pick(names).alias(c) for c, names in columns.items()])


def non_empty(df: DataFrame) -> DataFrame:
    """An empty file is an error, not an empty result."""
    if df.isEmpty():
        raise ValueError("no data rows")
    return df


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"unexpected schema, missing {missing}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tolerant: lines that are no JSON object are skipped, a mistyped field reads as null."""
    lines = spark.read.text(path).select("value")
    whole = lines.filter(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return whole.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Corrupt evidence aborts the job."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def kickoff_day(kickoff_text: Column) -> Column:
    """Shard value: UTC day, or unknown-date."""
    return F.coalesce(F.date_format(times.strict_utc(kickoff_text), "yyyy-MM-dd"), F.lit("unknown-date"))


def write_shards(df: DataFrame, path: str, kickoff: Column, mode: str = "append") -> None:
    """Append to day shards. Rows meet by day first, so a day is few files; AQE splits an oversized day."""
    df.withColumn("kickoff_day", kickoff_day(kickoff)).hint("rebalance", "kickoff_day").write.mode(mode).partitionBy("kickoff_day").parquet(path)


def read_shards(spark: SparkSession, path: str, legacy: DataFrame | None = None) -> DataFrame:
    shards = spark.read.parquet(path)
    return shards if legacy is None else legacy.unionByName(shards, allowMissingColumns=True)


def league_rows(raw: DataFrame, divisions: Sequence[str], min_season: str, max_season: str) -> DataFrame:
    """Multi-league file to multi-market rows with a reason; null reason = accepted."""
    require_columns(raw, LEAGUE_FILE)
    num = lambda c: prices.number(F.col(c))
    pos = lambda c: F.when(num(c) > 0, num(c))
    day = F.col("MatchDate").try_cast("date")
    df = raw.filter(F.col("Division").isin(*divisions)).select(
        F.col("Division").alias("division"), F.col("MatchDate").alias("date"), F.col("HomeTeam").alias("home"), F.col("AwayTeam").alias("away"),
        times.season_code(day).alias("season"), num("FTHome").cast("int").alias("home_goals"), num("FTAway").cast("int").alias("away_goals"),
        pos("OddHome").alias("h"), pos("OddDraw").alias("d"), pos("OddAway").alias("a"), pos("Over25").alias("over_price"), pos("Under25").alias("under_price"),
        num("HandiSize").alias("home_line"), pos("HandiHome").alias("ah_home"), pos("HandiAway").alias("ah_away"),
    )
    needed = ["home_goals", "away_goals", "h", "d", "a", "over_price", "under_price", "home_line", "ah_home", "ah_away", "season"]
    missing = F.lit(False)
    for c in needed:
        missing = missing | F.col(c).isNull()
    total = prices.inverse(F.col("h")) + prices.inverse(F.col("d")) + prices.inverse(F.col("a"))
    fh, fa = prices.inverse(F.col("h")) / total, prices.inverse(F.col("a")) / total
    side = prices.favorite_by_probability(fh, fa)
    reason = first_reason([
        (missing, "BAD_NUMBER"),
        ((F.col("season") < min_season) | (F.col("season") > max_season), "SEASON_OUT_OF_RANGE"),
        (~on_grid(F.col("home_line")), "OFF_GRID_LINE"),
    ])
    return df.select(
        "division", "date", "home", "away", "season", "home_goals", "away_goals", side.alias("favorite_side"),
        F.when(side == "H", fh).otherwise(fa).alias("favorite_fair_probability"),
        F.when(side == "H", F.col("home_line")).otherwise(-F.col("home_line")).alias("favorite_ah_line"),
        F.when(side == "H", F.col("ah_home")).otherwise(F.col("ah_away")).alias("favorite_ah_price"),
        F.lit(2.5).alias("ou_line"), "over_price", "under_price", reason.alias("reason"),
    )


def scan_manifest(raw: DataFrame, expected: DataFrame, kept: Column, keys: Sequence[str]) -> DataFrame:
    """Rows and kept rows per expected file key; expected files without rows are MISSING."""
    got = raw.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(kept).alias("kept_rows"))
    j = expected.join(got, list(keys), "left")
    return j.select(
        *keys, F.when(F.col("rows").isNull(), "MISSING").otherwise("OK").alias("status"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("kept_rows", F.lit(0)).cast("long").alias("kept_rows"),
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each input file (season-sized files; use the table format's own manifests for larger ones)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def current_market_rows(raw: DataFrame) -> DataFrame:
    """'A vs B' event text to teams; off-grid lines become null, never rounded."""
    teams = F.split("event", r"(?i)\s+vs?\.?\s+", 2)
    return raw.select(
        "*", F.trim(F.get(teams, F.lit(0))).alias("home"), F.trim(F.get(teams, F.lit(1))).alias("away"),
        grid_or_null(prices.number(F.col("line_text"))).alias("line"), prices.price(F.col("price_text")).alias("price"),
    )


def page_results(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """Score from the page's og:title, only when the URL's mid parameter equals the expected id."""
    title = F.regexp_extract("html", r"""<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)["']""", 1)
    score = F.regexp_extract(title, r"(\d{1,2})\s*[:-]\s*(\d{1,2})", 0)
    hg = F.regexp_extract(title, r"(\d{1,2})\s*[:-]\s*(\d{1,2})", 1).try_cast("int")
    ag = F.regexp_extract(title, r"(\d{1,2})\s*[:-]\s*(\d{1,2})", 2).try_cast("int")
    mid = F.regexp_extract("url", r"[?&]mid=([^&#]*)", 1)
    j = pages.join(refs, "page_id")
    reason = first_reason([
        (F.coalesce(mid, F.lit("")) != F.col("expected_id"), "FINAL_URL_ID_MISMATCH"),
        (F.coalesce(score, F.lit("")) == "", "SCORE_NOT_FOUND"),
        ((hg > 30) | (ag > 30), "SCORE_OUT_OF_RANGE"),
    ])
    return j.withColumn("reason", reason).select(
        "page_id", "reason", F.when(F.col("reason").isNull(), hg).alias("ft_home_goals"), F.when(F.col("reason").isNull(), ag).alias("ft_away_goals")
    )


def page_inventory(pages: DataFrame) -> DataFrame:
    """Structured data of a page: JSON-LD blocks and their types, og properties, scripts."""
    ld = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), 1)
    og = F.regexp_extract_all("html", F.lit(r"""<meta[^>]+property=["'](og:[a-z:_]+)["']"""), 1)
    types = F.transform(ld, lambda x: F.get_json_object(x, "$['@type']"))
    return pages.select(
        "page_id", F.size(ld).alias("json_ld_blocks"), F.array_join(F.array_sort(F.array_compact(types)), ",").alias("json_ld_types"),
        F.size(og).alias("og_properties"), F.size(F.regexp_extract_all("html", F.lit("(?i)<script"), 0)).alias("scripts"),
        F.size(F.regexp_extract_all("html", F.lit("(?i)<a "), 0)).alias("links"),
    )
