"""Readers and writers by format, with column pruning left to the scan, and reports about files and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = {"csv": "csv", "tsv": "tsv", "txt": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}


def kind_of(path: str) -> str:
    """The format that a path's suffix tells; csv if it tells none."""
    name = path.rstrip("/").rpartition("/")[2].lower().removesuffix(".gz")
    return SUFFIXES.get(name.rpartition(".")[2], "csv")


def read(spark: SparkSession, path: str, kind: str | None = None, columns: list[str] | None = None, schema=None, sep: str = ",", header: bool = True, skip: int = 0, multiline: bool = False) -> DataFrame:
    """A table from csv, tsv, parquet, json or orc files. Without a schema, csv types are inferred, which scans it twice.

    ``skip`` drops the first lines of each csv file, before its header.
    """
    kind = kind or kind_of(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind in ("csv", "tsv"):
        sep = "\t" if kind == "tsv" else sep
        if skip:
            lines = _without_first(spark, path, skip)
            strings = getattr(lines._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
            reader = reader.options(sep=sep, header=header, inferSchema=schema is None)
            out = DataFrame(reader._jreader.csv(strings), spark)
        else:
            out = reader.csv(path, sep=sep, header=header, inferSchema=schema is None)
    elif kind == "json":
        out = reader.json(path, multiLine=multiline)
    else:
        out = reader.format(kind).load(path)
    return out.select(*columns) if columns else out


def _without_first(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """The lines of text files but for the first ``skip`` of each, which lie in the first block of their file.

    Files are read in blocks like any others; where a block's lines begin is told by numbers that rise within a task.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("head"), F.monotonically_increasing_id().alias("i"))
    first = rows.where("head").groupBy("file").agg(F.min("i").alias("first"))
    kept = rows.join(F.broadcast(first), "file", "left").where(~F.col("head") | (F.col("i") >= F.col("first") + skip))
    return kept.where("value <> ''").select("value")


def chunks(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with chunk: rows in order, ``size`` a chunk, each with all columns and their names; a task has whole chunks or parts."""
    from ..functions.ranks import numbered

    return numbered(df, order).select(*df.columns, F.floor(F.col("__i") / size).alias("chunk"))


def excel(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The first sheet of a workbook (.xlsx), read on the driver, as workbooks are small; a column is numeric if all its cells are.

    Only Spark opens the path. Formulas give their kept values; dates are the numbers that the sheet has.
    """
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    book = zipfile.ZipFile(io.BytesIO(data))
    tag = lambda e: e.tag.rpartition("}")[2]
    said = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    shared = [said(x) for x in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    rows: list[dict[int, object]] = []
    for row in (e for e in ET.fromstring(book.read(sheets[0])).iter() if tag(e) == "row"):
        cells: dict[int, object] = {}
        for at, cell in enumerate(e for e in row if tag(e) == "c"):
            letters = re.sub(r"[^A-Z]", "", cell.get("r", ""))
            column = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1 if letters else at
            value = next((v.text for v in cell if tag(v) == "v"), None)
            kind = cell.get("t")
            cells[column] = said(cell) if kind == "inlineStr" else None if value is None else shared[int(value)] if kind == "s" else value if kind in ("str", "b", "e") else float(value)
        rows.append(cells)
    width = max((max(r, default=-1) + 1 for r in rows), default=0)
    table = [[r.get(i) for i in range(width)] for r in rows]
    names = [str(v) if v is not None else f"column_{i}" for i, v in enumerate(table[0])] if header and table else [f"column_{i}" for i in range(width)]
    body = table[1:] if header else table
    numeric = [all(r[i] is None or isinstance(r[i], float) for r in body) for i in range(width)]
    body = [[v if numeric[i] or v is None else f"{v:g}" if isinstance(v, float) else v for i, v in enumerate(r)] for r in body]
    return spark.createDataFrame(body, ", ".join(f"`{n}` {'double' if k else 'string'}" for n, k in zip(names, numeric, strict=True)))


def write(df: DataFrame, path: str, kind: str | None = None, mode: str = "errorifexists", files: int | None = None) -> None:
    """Writes csv (with a header), tsv, parquet, json or orc, into ``files`` files if given."""
    kind = kind or kind_of(path)
    out = (df.coalesce(files) if files else df).write.mode(mode)
    if kind in ("csv", "tsv"):
        out.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        out.format(kind).save(path)


def info(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """format, bytes, files, rows and columns of what lies at a path."""
    df = read(spark, path, kind)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").agg(F.sum("length"), F.count("*")).first()
    return spark.createDataFrame([(kind or kind_of(path), files[0], files[1], df.count(), len(df.columns))], "format string, bytes long, files long, rows long, columns int")


def size_class(rows: int) -> str:
    for bound, name in ((1_000, "tiny"), (10_000, "small"), (100_000, "medium"), (1_000_000, "large")):
        if rows < bound:
            return name
    return "huge"


def downcast(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type): the narrowest integer type that holds each column's values."""
    row = df.agg(*[f(c).alias(f"{c}__{i}") for c in columns for i, f in enumerate((F.min, F.max))])

    def fit(c: str) -> Column:
        low, high = F.col(f"{c}__0"), F.col(f"{c}__1")
        return F.when((low >= -128) & (high <= 127), "tinyint").when((low >= -32768) & (high <= 32767), "smallint").when((low >= -(2**31)) & (high <= 2**31 - 1), "int").otherwise("bigint")

    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), fit(c).alias("type")) for c in columns])).alias("s")).select("s.*")


def url_source(url: Column) -> Column:
    """What kind of place a URL is, by its text alone; nothing is fetched."""
    low = F.lower(url)
    return (
        F.when(low.rlike(r"^https?://(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[::1\])"), "blocked").when(~low.rlike("^https?://"), "invalid").when(low.rlike(r"^https?://(www\.)?kaggle\.com/"), "kaggle")
        .when(low.rlike(r"^https?://(www\.)?(raw\.)?github(usercontent)?\.com/"), "github").when(low.rlike(r"^https?://docs\.google\.com/spreadsheets/"), "sheets").when(low.rlike(r"^https?://huggingface\.co/datasets/"), "huggingface").otherwise("direct")
    )


def url_format(url: Column) -> Column:
    path = F.regexp_replace(F.lower(url), r"[?#].*$", "")
    return F.when(path.rlike(r"\.csv$"), "csv").when(path.rlike(r"\.tsv$"), "tsv").when(path.rlike(r"\.jsonl?$"), "json").when(path.rlike(r"\.(parquet|pq)$"), "parquet").when(path.rlike(r"\.xlsx?$"), "excel").otherwise("unknown")
