"""Bars from CSV files, one file per ticker (S1-S4, S13), and the fundamentals file.

Files lie in a folder each on its own, or many of them packed into one table (``PACKED``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volsignals.functions.numeric import DATE_FORMATS, clean_number, order_votes
from volsignals.operators.store import keep_last
from volsignals.schema import BARS, PRICES
from volsignals.session import written
from volsignals.sources.cleaning import REQUIRED, canonical, parse
from volsignals.texts import CSV_SOURCE

TEXT_SCHEMA = ", ".join(f"`{c}` STRING" for c in REQUIRED)


def ticker_of(uri: Column) -> Column:
    """Last part of a file URI without ``.csv`` and without every ``_data`` in it."""
    name = F.replace(F.regexp_extract(uri, "[^/]+$", 0), F.lit("+"), F.lit("%2B"))
    stem = F.regexp_replace(F.url_decode(name), r"\.csv$", "")
    return F.replace(stem, F.lit("_data"), F.lit(""))


def _order(uris: Iterable[tuple[str, str]] = ()) -> Column:
    """Place of a row among those of its ticker: the files by name, their blocks, the rows in turn.

    ``uris``: files and their tickers. As a number, which a hash aggregation can compare, where few
    tickers have several files; a row's id in its task and its block's offset have 10 and 14 digits.
    """
    own: dict[str, list[str]] = {}
    for uri, ticker in sorted(uris):
        own.setdefault(ticker, []).append(uri)
    return _placed([(uri, k) for files in own.values() for k, uri in enumerate(files) if k] if own else None)


def _placed(later: list[tuple[str, int]] | None) -> Column:
    """The order from ``later``: every file that is not its ticker's first, and its place among them."""
    if later is None or len(later) > MOST_NAMED:
        return F.struct("_file", "_block", F.col("_row"))
    place = F.lit(0)
    for k in {k for _, k in later}:
        place = F.when(F.col("_file").isin([uri for uri, n in later if n == k]), F.lit(k)).otherwise(place)
    block = (place.cast("bigint") * 10**14 + F.col("_block")).cast("decimal(20,0)") * F.lit(10**11).cast("decimal(12,0)")
    return block + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(11,0)")


def read_uniform(
    spark: SparkSession,
    path: str,
    ingest_seq: int,
    ticker: str | None = None,
    source: str = CSV_SOURCE,
    thousands: bool = False,
    formats: tuple[str, ...] = DATE_FORMATS,
    folders: bool = False,
) -> DataFrame:
    """Files whose header is exactly the six columns in their usual order; one scan.

    Spark maps CSV columns by position, so a file with another header fails the read instead
    of having its columns swapped; :func:`load_folder` takes such files. With ``folders`` a file's
    name is that of the folder it lies in.
    """
    name = folder_name if folders else file_name
    files = spark.read.schema(TEXT_SCHEMA).options(header=True, enforceSchema=False).csv(path)
    raw = (
        files.select(
            "*",
            (F.lit(ticker) if ticker else ticker_of(name(F.col("_metadata.file_path")))).alias("ticker"),
            F.input_file_name().alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    names = spark.createDataFrame([(uri,) for uri in files.inputFiles()], "uri STRING")
    ranked = names.select("uri", F.lit(ticker) if ticker else ticker_of(name(F.col("uri")))).collect()
    return canonical(parse(raw, thousands, formats), source, ingest_seq, _order(map(tuple, ranked)))


@dataclass(frozen=True)
class Load:
    bars: DataFrame  # clean bars of the accepted files
    files: DataFrame  # file, ticker, status, rows, bad_dates


def _lines(text: DataFrame) -> DataFrame:
    return text.select(
        "value",
        F.input_file_name().alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


#: Headers that get a scan of their own; files with other headers are read line by line.
MOST_HEADERS = 24
#: Files that a scan's expression names one by one; more of them are a scan of their own.
MOST_NAMED = 2000


def load_folder(
    spark: SparkSession,
    folder: str,
    ingest_seq: int,
    only: list[str] | None = None,
    source: str = CSV_SOURCE,
    thousands: bool = False,
    formats: tuple[str, ...] = DATE_FORMATS,
    folders: bool = False,
) -> Load:
    """Every ``*.csv`` of a folder, columns taken by name from each file's own header.

    A first pass over the lines finds each file's header, and whether a quoted field runs over a
    line's end; a second one parses the dates and finds whether days or months come first where the
    year is last. Both end in one row per file on the driver, which holds the file's name in any
    case. Files that agree in header and line ends are one native CSV scan, split like any other unless
    fields run over lines: no line is shuffled to meet its file's header. With ``folders`` each
    file lies in a folder of its own name, as a partitioned writer leaves it (``name=T1_data.csv``).
    A folder that is missing or has no such file gives no bars and no files.
    """
    glob = f"{folder}/*.csv/*" if folders else f"{folder}/*.csv"
    try:
        # The names in the scan's own file index, which the driver holds in any case. Unlike a
        # scan's rows, they include the empty files.
        text = spark.read.text(glob)
        uris = text.inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        none = "file STRING, ticker STRING, status STRING, rows BIGINT, bad_dates BIGINT"
        return Load(spark.createDataFrame([], BARS), spark.createDataFrame([], none))
    name = folder_name if folders else file_name
    files = spark.createDataFrame([(uri,) for uri in uris], "_file STRING").withColumn("ticker", ticker_of(name(F.col("_file"))))
    tickers = {r._file: r.ticker for r in files.filter(_wanted(only)).collect()}
    wanted = set(tickers)
    if only is not None and wanted:
        text = spark.read.text(_paths(sorted(wanted)))
    heads = _headers(_lines(text), wanted) if wanted else {}
    common = [h for h, _ in Counter(names for names, _ in heads.values()).most_common(MOST_HEADERS)]
    groups: dict[tuple, list[str]] = {}
    for uri, (names, over) in heads.items():
        if names in common:
            groups.setdefault((names, over), []).append(uri)
    scans = {key: _scan(spark, own, *key, name) for key, own in groups.items()}
    votes = _day_first(scans.values())
    parsed = []
    for (names, over), own in groups.items():
        first, last = ([uri for uri in own if votes.get(uri, True) == x] for x in (True, False))
        if not first or not last:
            some = [(scans[names, over], F.lit(bool(first)))]
        elif min(len(first), len(last)) <= MOST_NAMED:
            few, is_first = (first, True) if len(first) <= len(last) else (last, False)
            some = [(scans[names, over], F.col("_file").isin(few) == F.lit(is_first))]
        else:
            some = [(_scan(spark, x, names, over, name), F.lit(x is first)) for x in (first, last)]
        parsed += [parse(rows.withColumn("_text", F.col("Date")), thousands, formats, day) for rows, day in some]
    rest = [uri for uri, (names, _) in heads.items() if names not in common]
    if rest:
        others = spark.createDataFrame([(uri,) for uri in rest], "_file STRING").withColumn("ticker", ticker_of(name(F.col("_file"))))
        parsed.append(_parsed_lines(_lines(spark.read.text(_paths(rest))), others, thousands, formats)[1])
    if not parsed:  # no file can be used
        empty = spark.createDataFrame([], ", ".join(f"{c} STRING" for c in (*REQUIRED, "ticker", "_file", "_text")) + ", _block LONG, _row LONG")
        parsed = [parse(empty)]
    rows = reduce(DataFrame.unionByName, parsed)
    order = _order((uri, tickers[uri]) for uri in heads)
    return _load(rows, files.withColumn("_wanted", _wanted(only)), source, ingest_seq, order)


def _wanted(only: list[str] | None) -> Column:
    return F.lit(True) if only is None else F.col("ticker").isin(list(only))


def _paths(uris: list[str]) -> list[str]:
    """File URIs as paths that a reader takes literally."""
    return [re.sub(r"([*?{}\[\]\\])", r"\\\1", unquote(uri)) for uri in uris]


def _headers(lines: DataFrame, wanted: set[str]) -> dict[str, tuple[tuple[str, ...], bool]]:
    """Column names of each wanted file that has all required ones, and whether a field runs over lines.

    Only lines with all required names can be a usable header, so they alone are grouped by their
    text; of the others a number per file is enough. All of it is combined before the shuffle.
    """
    value = F.col("value")
    possible = F.lit(True)
    for c in REQUIRED:
        possible = possible & value.contains(c)
    at_start = (F.col("_block") == 0) & (F.trim("value") != "")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumns({
        "_head": F.when(possible & at_start, value), "_first": F.when(at_start, F.col("_row")),
        "_odd": (quotes % 2).cast("int"),
    })
    texts = lines.groupBy("_file", "_head").agg(F.min("_first").alias("_first"), F.max("_odd").alias("_odd"))
    found = texts.groupBy("_file").agg(
        F.min_by("_head", F.when(F.col("_first").isNotNull(), F.col("_first"))).alias("head"), F.max("_odd").alias("odd")
    )
    out = {}
    for r in found.collect():
        if r._file in wanted and r["head"] is not None:
            names = tuple(re.sub('^\ufeff|"', "", r["head"]).split(","))
            if all(c in names for c in REQUIRED):
                out[r._file] = names, bool(r.odd)
    return out


def file_name(uri: Column) -> Column:
    return uri


def folder_name(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(uri, "([^/]+)/[^/]+$", 1), "^[^=]*=", "")


def _scan(
    spark: SparkSession, uris: list[str], names: tuple[str, ...], over: bool, name: Callable[[Column], Column] = file_name
) -> DataFrame:
    """One native scan of files with one header: the six columns as text, and each row's place."""
    schema = ", ".join(f"c{i} STRING" for i in range(len(names)))
    raw = spark.read.schema(schema).options(header=True, enforceSchema=True, multiLine=over, escape='"').csv(_paths(uris))
    return raw.select(
        *[F.col(f"c{names.index(c)}").alias(c) for c in REQUIRED],
        ticker_of(name(F.col("_metadata.file_path"))).alias("ticker"),
        F.input_file_name().alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def _votes() -> list[Column]:
    """Aggregates over a file's dates: those that can only have the day first, the month first, slashes."""
    return [
        F.count_if(order_votes(F.col("Date")) > 0).alias("_day"),
        F.count_if(order_votes(F.col("Date")) < 0).alias("_month"),
        F.count_if(F.trim("Date").rlike(r"^\d{1,2}/")).alias("_slashes"),
    ]


def _by_votes() -> Column:
    """Hyphens mean the day first unless the file says otherwise, slashes the month."""
    return F.when(F.col("_day") != F.col("_month"), F.col("_day") > F.col("_month")).otherwise(F.col("_slashes") == 0)


def _day_first(scans: Iterable[DataFrame]) -> dict[str, bool]:
    """Per file with dates, whether days come first where the year is last; reads the date column."""
    dates = [rows.select("_file", "Date") for rows in scans]
    if not dates:
        return {}
    per_file = reduce(DataFrame.unionByName, dates).groupBy("_file").agg(*_votes())
    return {r._file: r.first for r in per_file.select("_file", _by_votes().alias("first")).collect()}


def _load(parsed: DataFrame, files: DataFrame, source: str, ingest_seq: int, order: Column) -> Load:
    """Bars of parsed rows, and the outcome of each of ``files`` (_file, ticker, _wanted)."""
    bars = canonical(parsed, source, ingest_seq, order)
    good = F.col("date").isNotNull() & F.coalesce(*PRICES).isNotNull()
    # a header or a blank is no date that failed
    failed = F.col("date").isNull() & (F.trim("_text") != "") & (F.trim("_text") != "Date")
    rows = parsed.groupBy("_file").agg(
        F.count_if(good).alias("rows"), F.count_if(failed).alias("bad_dates")
    )
    zero = F.lit(0).cast("bigint")
    status = (
        files.select("_file", "ticker", "_wanted")
        .join(rows, "_file", "left")
        .select(
            F.col("_file").alias("file"),
            "ticker",
            F.when(~F.col("_wanted"), "skipped")
            .when(F.col("rows") > 0, "success")
            .otherwise("failed")
            .alias("status"),
            F.coalesce("rows", zero).alias("rows"),
            F.coalesce("bad_dates", zero).alias("bad_dates"),
        )
    )
    return Load(bars, status)


def load_lines(
    lines: DataFrame,
    files: DataFrame,
    ingest_seq: int,
    only: list[str] | None = None,
    source: str = CSV_SOURCE,
    thousands: bool = False,
    formats: tuple[str, ...] = DATE_FORMATS,
) -> Load:
    """The same from ``lines`` (value, _file, _block, _row) of ``files`` (_file, ticker).

    First pass: the first line of every file, a map-side combined aggregation with one row per
    file. Second pass: every line is parsed by position and its six fields picked through the
    header of its file. A file that lacks a column is rejected alone. Whether days or months come
    first where the year is last is chosen per file, by the dates that can only be read one way;
    months, where there is none. The header line itself needs no special care: its date does not
    parse. Dates that do not parse are counted in ``files``.
    """
    files = files.withColumn("_wanted", _wanted(only))
    plan, parsed = _parsed_lines(lines, files, thousands, formats)
    return _load(parsed, plan, source, ingest_seq, _order())


def _parsed_lines(
    lines: DataFrame, files: DataFrame, thousands: bool, formats: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    """``files`` with the places of their columns, and the parsed rows of those that can be used."""
    names = F.split(F.regexp_replace(F.regexp_replace("_header", "^\ufeff", ""), '"', ""), ",")
    headers = (
        lines.filter("_block = 0")
        .groupBy("_file")
        .agg(F.min_by("value", "_row").alias("_header"))
        .select("_file", names.alias("_names"))
    )
    place = {c: F.array_position("_names", c).cast("int") for c in REQUIRED}
    usable = F.lit(True)
    for c in REQUIRED:
        usable = usable & (place[c] > 0)
    if "_wanted" not in files.columns:
        files = files.withColumn("_wanted", F.lit(True))
    plan = (
        files.join(headers, "_file", "left")
        .withColumn("_usable", F.coalesce(usable, F.lit(False)))
        .withColumn("_place", F.struct(*[place[c].alias(c) for c in REQUIRED]))
    )
    accepted = plan.filter("_wanted AND _usable").select("_file", "ticker", "_place")
    # the last field that an accepted file needs; others may be as wide as they like
    width = accepted.agg(F.max(F.greatest(*[F.col(f"_place.{c}") for c in REQUIRED]))).first()[0]
    width = width or len(REQUIRED)
    fields = F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(width)))
    picked = (
        lines.join(accepted, "_file")
        .withColumn("_fields", fields)
        .withColumn("_cells", F.array(*[F.col(f"_fields.c{i}") for i in range(width)]))
        .select(
            "ticker", "_file", "_block", "_row",
            *[F.try_element_at("_cells", F.col(f"_place.{c}")).alias(c) for c in REQUIRED],
        )
    )
    votes = picked.groupBy("_file").agg(*_votes())
    ordered = picked.join(votes.select("_file", _by_votes().alias("_day_first")), "_file")
    return plan, parse(ordered.withColumn("_text", F.col("Date")), thousands, formats, F.col("_day_first")).drop("_day_first")


#: Many small files as one table, a row for each record of each file: the file's name, its header line, the
#: record's number in it, and the record as text. A file without records has one row without a text.
PACKED = "name STRING, header STRING, line BIGINT, value STRING"


def packed(lines: DataFrame) -> DataFrame:
    """``PACKED`` rows of ``lines`` (name, value, _row), each with the first line of its file that is not blank.

    One shuffle and one sort on the name, whatever the number of files. A folder with a file for each ticker
    costs a few milliseconds a file in each step that lists, opens or renames it; the packed table
    costs what its bytes cost.
    """
    w = Window.partitionBy("name").orderBy("_row")
    head = F.when(F.trim("value") != "", F.col("value"))
    return lines.select(
        "name", F.first(head, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("header"),
        F.row_number().over(w).cast("bigint").alias("line"), "value",
    )


def _named(header: Column) -> Column:
    return F.split(F.regexp_replace(header, '^\ufeff|"', ""), ",")


def _unpacked(lines: DataFrame) -> DataFrame:
    return lines.select(
        "header", "value", F.col("name").alias("_file"), F.lit(0).cast("bigint").alias("_block"), F.col("line").alias("_row")
    )


def packed_fields(lines: DataFrame) -> DataFrame:
    """S1 of ``PACKED`` rows: the six columns as text, the ticker, and each row's place. Fails at a file whose
    header is not the six columns in their usual order."""
    usual = F.lower(F.array_join(_named(F.col("header")), ",")) == ",".join(REQUIRED).lower()
    odd = F.raise_error(F.concat(F.lit("unexpected header in "), F.col("name")))
    rows = lines.withColumn("value", F.when(F.col("header").isNull() | usual, F.col("value")).otherwise(odd))
    # a generator keeps the optimizer from parsing a line for each of its fields
    fields = F.inline(F.array(F.from_csv("value", TEXT_SCHEMA)))
    others = [c for c in lines.columns if c not in ("name", "header", "line", "value")]
    return rows.select(
        *others, F.col("name").alias("_file"), F.lit(0).cast("bigint").alias("_block"), F.col("line").alias("_row"),
        ticker_of(F.col("name")).alias("ticker"), fields,
    )


def _later(files: DataFrame) -> list[tuple[str, int]]:
    """Of ``files`` (_file, ticker), those that are not their ticker's first, by name; no more than are ever named."""
    w = Window.partitionBy("ticker").orderBy("_file")
    late = files.select("_file", (F.row_number().over(w) - 1).alias("_k")).filter("_k > 0")
    return [(r._file, r._k) for r in late.limit(MOST_NAMED + 1).collect()]


def read_packed(
    spark: SparkSession,
    folder: str,
    ingest_seq: int,
    source: str = CSV_SOURCE,
    thousands: bool = False,
    formats: tuple[str, ...] = DATE_FORMATS,
) -> DataFrame:
    """:func:`read_uniform` over files that were packed."""
    lines = spark.read.schema(PACKED).parquet(folder)
    files = lines.select(F.col("name").alias("_file")).distinct().withColumn("ticker", ticker_of(F.col("_file")))
    return canonical(parse(packed_fields(lines), thousands, formats), source, ingest_seq, _placed(_later(files)))


def load_packed(
    spark: SparkSession,
    folder: str,
    ingest_seq: int,
    only: list[str] | None = None,
    source: str = CSV_SOURCE,
    thousands: bool = False,
    formats: tuple[str, ...] = DATE_FORMATS,
) -> Load:
    """:func:`load_folder` over files that were packed, however many they are.

    A first pass counts each file's dates by what they say about days and months, which is combined before
    the shuffle to one row per file; that table is written. The second pass meets it in one join by name,
    which Spark splits where a file is large, and parses. No file's name gets to the driver, but for
    those of tickers with several files.
    """
    lines = spark.read.schema(PACKED).parquet(folder)
    heads = lines.select("header").distinct().select(_named(F.col("header")).alias("_names"))
    usable = reduce(Column.__and__, [F.array_contains("_names", c) for c in REQUIRED])
    # the last field that a usable file needs
    width = heads.filter(usable).agg(
        F.max(F.greatest(*[F.array_position("_names", c) for c in REQUIRED]))
    ).first()[0] or len(REQUIRED)
    cells = F.inline(F.array(F.struct(F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(width))).alias("_fields"))))
    cell = lambda place: F.try_element_at(F.array(*[F.col(f"_fields.c{i}") for i in range(width)]), place)
    rows = _unpacked(lines)
    place = lambda c: F.nullif(F.array_position(_named(F.col("header")), c), F.lit(0)).cast("int")
    dates = rows.select("_file", "header", cells).select("_file", "header", cell(place("Date")).alias("Date"))
    votes = dates.groupBy("_file").agg(F.max("header").alias("header"), *_votes())
    plan = written(
        votes.withColumn("_names", _named(F.col("header")))
        .select(
            "_file", ticker_of(F.col("_file")).alias("ticker"), F.coalesce(usable, F.lit(False)).alias("_usable"),
            F.struct(*[F.array_position("_names", c).cast("int").alias(c) for c in REQUIRED]).alias("_place"),
            _by_votes().alias("_day_first"),
        ),
        "files",
    ).withColumn("_wanted", _wanted(only))
    accepted = plan.filter("_wanted AND _usable").select("_file", "ticker", "_place", "_day_first")
    picked = (
        rows.drop("header").join(accepted, "_file")
        .select("ticker", "_file", "_block", "_row", "_place", "_day_first", cells)
        .select("ticker", "_file", "_block", "_row", "_day_first", *[cell(F.col(f"_place.{c}")).alias(c) for c in REQUIRED])
    )
    parsed = parse(picked.withColumn("_text", F.col("Date")), thousands, formats, F.col("_day_first")).drop("_day_first")
    return _load(parsed, plan, source, ingest_seq, _placed(_later(plan.filter("_wanted AND _usable"))))


def load_stats(files: DataFrame) -> DataFrame:
    """One row of file counts, and how many rows were dropped for their date."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return files.agg(
        n("success"), n("failed"), n("skipped"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("bad_dates"), F.lit(0).cast("bigint")).alias("bad_dates"),
    )


def read_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """CSV ``ticker,paid_up_capital``; rows without a usable number are left out, and of
    several rows for a ticker the last one counts."""
    rows = (
        spark.read.schema("ticker STRING, paid_up_capital STRING")
        .options(header=True, enforceSchema=False)
        .csv(path)
        .select(
            F.trim("ticker").alias("ticker"),
            clean_number(F.col("paid_up_capital"), thousands=True).alias("paid_up_capital"),
            F.struct(
                F.col("_metadata.file_path"),
                F.col("_metadata.file_block_start"),
                F.monotonically_increasing_id(),
            ).alias("_order"),
        )
        .na.drop(subset=["ticker", "paid_up_capital"])
    )
    return keep_last(rows, ["ticker"], F.col("_order")).drop("_order")
