"""Watchlists as files: five forms written and read, the form told from the content, and what could not be read kept apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.quality import normalize_symbol

FORMATS = ("json", "csv", "txt", "named", "flagged")
#: The flag of each exchange in flagged codes, other spellings of the forms, header names and texts of a held row.
EXCHANGE_FLAGS = {"SH": "1", "SZ": "0", "BJ": "2"}
SPELLINGS = {"jsonl": "json", "codes": "txt", "ths": "named", "tdx": "flagged"}
HEADERS = {"symbol": ["代码", "code", "symbol"], "name": ["名称", "name"], "source": ["来源", "source"], "board": ["板块", "board"], "held": ["持仓", "held"]}
CSV_HEADER = "代码,名称,来源,来源文件,板块,持仓,加入日期"
HELD = ["是", "1", "true", "True", "Y", "y"]
ITEM = "symbol string, code string, name string, source string, source_file string, board array<string>, held boolean, added_at string"
COLUMNS = ("symbol", "name", "source", "source_file", "board", "held", "added_at")


def _form(fmt: str) -> str:
    found = SPELLINGS.get(fmt.lower(), fmt.lower())
    if found not in FORMATS:
        raise ValueError(f"unknown format {fmt}; there are {', '.join(FORMATS)}")
    return found


def _cell(c: Column) -> Column:
    """A text as a CSV cell: quoted where it has to be."""
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def export_lines(watchlist: DataFrame, fmt: str) -> DataFrame:
    """One column ``value``: the lines of a watchlist (symbol as ``600519.SH``; name, source, source_file, board, held and added_at if
    it has them). json: an object a line, nothing lost; csv: seven columns, without the header CSV_HEADER; txt: symbols; named:
    six digits and the name; flagged: the exchange's flag (SH 1, SZ 0, BJ 2, others 1) before six digits.
    """
    fmt = _form(fmt)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in watchlist.columns else F.lit("")
    board = F.coalesce(F.array_join("board", "|"), F.lit("")) if "board" in watchlist.columns else F.lit("")
    held = F.when(F.col("held"), HELD[0]).otherwise("") if "held" in watchlist.columns else F.lit("")
    digits, exchange = F.substring_index("symbol", ".", 1), F.upper(F.substring_index("symbol", ".", -1))
    flag = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in EXCHANGE_FLAGS.items() for x in pair)), exchange), F.lit("1"))
    lines = {
        "json": F.to_json(F.struct(*(F.col(c) for c in COLUMNS if c in watchlist.columns))),
        "csv": F.concat_ws(",", *map(_cell, (F.col("symbol"), text("name"), text("source"), text("source_file"), board, held, text("added_at")))),
        "txt": F.col("symbol"),
        "named": F.rtrim(F.concat_ws(" ", digits, F.trim(text("name")))),
        "flagged": F.concat(flag, digits),
    }
    return watchlist.select(lines[fmt].alias("value"))


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files: UTF-8 (with or without its mark) where that fits, else GB18030; nothing is lost to decoding errors.
    A watchlist is a small file; one task decodes one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "text": [_decoded(bytes(c)) for c in batch["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def _decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("gb18030", errors="replace")


def detected(text: Column) -> Column:
    """json behind [ or {; csv for one line with commas whose first cell is no number; else txt, which takes any list of codes."""
    t = F.trim(F.regexp_replace(text, r"^\s+", ""))
    first = F.replace(F.trim(F.substring_index(t, ",", 1)), F.lit("."), F.lit(""))
    one_line = ~t.contains("\n") & t.contains(",") & ~first.rlike(r"^\d+$")
    return F.when(t.rlike(r"^[\[{]"), "json").when(one_line, "csv").otherwise("txt")


def _items(files: DataFrame) -> DataFrame:
    """path, place, raw, and the fields of every entry of the files, by the form of each."""
    lines = files.where("fmt <> 'json'").select("path", "fmt", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line"))
    none = lambda kind: F.lit(None).cast(kind)
    entry = lambda code, name="", **k: F.struct(F.array(F.lit(0)).getItem(0).alias("n"), code.alias("code"), (name if isinstance(name, Column) else F.lit(name)).alias("name"), *(k.get(c, none(t)).alias(c) for c, t in (("source", "string"), ("source_file", "string"), ("board", "array<string>"), ("held", "boolean"), ("added_at", "string"))))

    # csv: cells of every line, their meaning from the file's first line if that is a header
    cells = F.from_csv(F.col("line"), ", ".join(f"c{i} string" for i in range(12)), {"escape": '"'})
    rows = lines.where("fmt = 'csv' and trim(line) <> ''").withColumn("cells", F.array(*(cells[f"c{i}"] for i in range(12))))
    w = Window.partitionBy("path")
    head = F.min_by("cells", "line_no").over(w)
    rows = rows.withColumns({"head": F.transform(head, lambda c: F.trim(F.coalesce(c, F.lit("")))), "first": F.col("line_no") == F.min("line_no").over(w)})
    rows = rows.withColumn("has_head", ~F.col("head")[0].rlike(r"\d{6}"))
    at = {c: F.coalesce(*(F.nullif(F.array_position("head", F.lit(h)), F.lit(0)) for h in names)) for c, names in HEADERS.items()}
    cell = lambda c: F.trim(F.get("cells", (at[c] - 1).cast("int")))
    named = entry(
        F.coalesce(cell("symbol"), F.trim(F.col("cells")[0])), F.coalesce(cell("name"), F.lit("")), source=F.coalesce(cell("source"), F.lit("manual")),
        board=F.filter(F.split(F.coalesce(cell("board"), F.lit("")), r"\|"), lambda b: b != ""), held=F.coalesce(cell("held").isin(HELD), F.lit(False)),
    )
    plain = entry(F.trim(F.col("cells")[0]), F.trim(F.coalesce(F.col("cells")[1], F.lit(""))))
    csv = rows.where("not (has_head and first)").select("path", "line_no", F.lit(0).alias("at"), F.col("line").alias("raw"), F.when(F.col("has_head"), named).otherwise(plain).alias("e"))

    tokens = lines.where("fmt = 'txt'").select("path", "line_no", F.posexplode(F.split("line", r"[\s,;]+")).alias("at", "raw")).where("raw <> ''")
    txt = tokens.select("path", "line_no", "at", "raw", entry(F.col("raw")).alias("e"))

    line = F.trim(F.regexp_replace("line", "[\"'\t]", " "))
    flags = F.create_map(*(F.lit(x) for exchange, flag in EXCHANGE_FLAGS.items() for x in (flag, exchange)))
    flagged_code = F.when(line.rlike(r"^[012]\d{6}"), F.concat_ws(".", F.substring(line, 2, 6), F.element_at(flags, F.substring(line, 1, 1)))).otherwise(F.regexp_extract(line, r"(\d{6})", 1))
    flagged = lines.where("fmt = 'flagged'").where(line != "").select("path", "line_no", F.lit(0).alias("at"), F.col("line").alias("raw"), entry(flagged_code).alias("e"))

    code = r"(?i)((?:(?:sh|sz|bj)[.]?)?\d{6}(?:[.](?:sh|sz|bj))?)"
    whole = F.regexp_extract("line", code, 1)
    rest = F.trim(F.regexp_replace(F.replace(F.col("line"), whole, F.lit(" ")), r"[\s,，|]+", " "))
    label = F.trim(F.regexp_replace(rest, r"^[\d.]+", ""))
    by_name = lines.where("fmt = 'named'").where(F.trim("line") != "").select("path", "line_no", F.lit(0).alias("at"), F.col("line").alias("raw"), entry(whole, label).alias("e"))

    # json: an array or an object with one, of texts or objects; or an object a line
    text = F.col("text")
    listed = F.coalesce(F.from_json(text, "array<string>"), F.from_json(F.get_json_object(text, "$.items"), "array<string>"), F.from_json(F.get_json_object(text, "$.watchlist"), "array<string>"), F.filter(F.split(text, r"[\r\n]+"), lambda x: F.trim(x) != ""))
    parts = files.where("fmt = 'json'").select("path", F.posexplode(listed).alias("line_no", "raw")).withColumn("o", F.from_json("raw", ITEM))
    is_object = F.trim("raw").startswith("{")
    item = entry(F.when(is_object, F.coalesce("o.symbol", "o.code")).otherwise(F.col("raw")), F.coalesce("o.name", F.lit("")), source=F.col("o.source"), source_file=F.col("o.source_file"), board=F.col("o.board"), held=F.col("o.held"), added_at=F.col("o.added_at"))
    json = parts.select("path", "line_no", F.lit(0).alias("at"), "raw", item.alias("e"))
    return csv.unionByName(txt).unionByName(flagged).unionByName(by_name).unionByName(json).select("path", F.struct("path", "line_no", "at").alias("place"), "raw", "e.*").drop("n")


def read_watchlist(spark: SparkSession, path: str, fmt: str = "auto") -> tuple[DataFrame, DataFrame]:
    """The watchlist of the files under ``path`` (one row for each symbol, of its first entry) and the entries refused (path, raw):
    those in which no symbol can be told. ``auto`` tells the form of each file from its content."""
    files = decoded_files(spark, path)
    files = files.withColumn("fmt", detected(F.col("text")) if fmt == "auto" else F.lit(_form(fmt)))
    entries = _items(files).withColumn("symbol", normalize_symbol(F.col("code")))
    known = entries.where("symbol is not null")
    source = F.when(F.col("f.source").isin("manual", "file", "board"), F.col("f.source")).otherwise("manual")
    first = known.groupBy("symbol").agg(F.min_by(F.struct("name", "source", "source_file", "board", "held", "added_at"), "place").alias("f"))
    made = first.select(
        "symbol", F.coalesce("f.name", F.lit("")).alias("name"), source.alias("source"), F.coalesce("f.source_file", F.lit("")).alias("source_file"), F.coalesce("f.board", F.array().cast("array<string>")).alias("board"),
        F.coalesce("f.held", F.lit(False)).alias("held"), F.coalesce("f.added_at", F.lit("")).alias("added_at"),
    )
    return made, entries.where("symbol is null").select("path", "raw")


def merge_watchlist(stored: DataFrame, new: DataFrame, mode: str = "merge") -> tuple[DataFrame, DataFrame]:
    """The watchlist after an import, and one row of counters (added, skipped, total). ``merge`` keeps stored rows as they are, held
    marks included, and adds what is new; ``replace`` takes the new rows alone."""
    fresh = new if mode == "replace" else new.join(stored.select("symbol"), "symbol", "left_anti")
    final = new if mode == "replace" else stored.unionByName(fresh, allowMissingColumns=True)
    counts = fresh.agg(F.count(F.lit(1)).alias("added")).join(new.agg(F.count(F.lit(1)).alias("_all"))).join(final.agg(F.count(F.lit(1)).alias("total")))
    return final, counts.select("added", (F.col("_all") - F.col("added")).alias("skipped"), "total")
