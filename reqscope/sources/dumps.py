"""Raw HTTP request dumps → typed request DataFrame.

Two inputs are supported:

* text files (``read_dump_files``): ``spark.read.text`` splits on LF, CRLF and lone
  CR like a text-mode read.  Lines keep file order through ``_metadata`` (file
  path, split start) and ``monotonically_increasing_id`` inside a split; block
  numbers come from a running count inside each split plus a prefix sum over the
  tiny per-split table, so no file is ever read by a single task.
* dumps held in a string column (``parse_dump_column``): split the text at every
  LF that precedes a request line (one regex split, no window), explode.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.request import (
    REQUEST_BOUNDARY_RE, is_request_line, parse_block_df, split_lines, strip_trailing_blanks,
    with_block_lines,
)

REQUEST_SCHEMA_DDL = (
    "pos long, source_file string, block_no long, method string, target string, version string, "
    "headers array<struct<name:string,value:string>>, body string, raw string, label int, split string"
)
REQUEST_COLUMNS = ("pos", "source_file", "block_no", "method", "target", "version", "headers",
                   "body", "raw", "label", "split")

# Fixed values that must equal the reference: the three dump files, their labels
# and roles.
CSIC_FILES = (
    ("normalTrafficTraining.txt", 0, "lm_train"),
    ("normalTrafficTest.txt", 0, "inference"),
    ("anomalousTrafficTest.txt", 1, "inference"),
)


def _valid_utf8(c: Column) -> Column:
    return F.make_valid_utf8(c)


def _dump_folders(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    """(path as given, its raw URI path) of the paths that are folders of part files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            out.append((p, fs.makeQualified(path).toUri().getRawPath()))
    return out


def read_dump_lines(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """(dump, source_file, split_start, mid, line) in file order, invalid UTF-8 → U+FFFD.

    ``dump`` is the folder for a dump that is a folder of part files, else the file."""
    if isinstance(paths, str):
        paths = [paths]
    df = spark.read.text(list(paths))
    file = F.col("_metadata.file_path")
    at = F.coalesce(F.try_parse_url(file, F.lit("PATH")), file)
    dump = file
    for given, raw in _dump_folders(spark, paths):
        dump = F.when(at.startswith(raw.rstrip("/") + "/"), F.lit(given)).otherwise(dump)
    return df.select(
        dump.alias("dump"), file.alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("mid"),
        _valid_utf8(F.col("value")).alias("line"),
    )


def files_with_bom(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Raw URI paths of the first files of those dumps that begin with a UTF-8 byte-order mark.

    The Hadoop line reader drops that mark, while a text-mode read keeps it (so a
    BOM-prefixed first request line does not open a block).  Three bytes per dump
    are read through the Hadoop FileSystem API.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for st in fs.globStatus(path) or []:
            files = sorted((x.getPath() for x in fs.listStatus(st.getPath()) if x.isFile()), key=lambda f: f.getName()) \
                if st.isDirectory() else [st.getPath()]
            files = [f for f in files if not f.getName().startswith(("_", "."))][:1]
            for f in files:
                stream = fs.open(f)
                try:
                    head = [stream.read() for _ in range(3)]
                finally:
                    stream.close()
                if head == [0xEF, 0xBB, 0xBF]:
                    out.append(f.toUri().getRawPath())
    return out


def split_starts(lines: DataFrame) -> DataFrame:
    """(dump, source_file, split_start, n_starts, offset): request lines per input split and in
    the splits before it, in order of part name and place.  One light pass; one row per split."""
    per_split = lines.groupBy("dump", "source_file", "split_start").agg(F.sum("is_start").alias("n_starts"))
    earlier = Window.partitionBy("dump").orderBy("source_file", "split_start").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.select("*", F.coalesce(F.sum("n_starts").over(earlier), F.lit(0)).alias("offset"))


def mark_starts(lines: DataFrame, strip_cr: bool = True, bom_files: Sequence[str] = ()) -> DataFrame:
    """Add ``is_start`` (1 for a line that opens a request block)."""
    if strip_cr:
        lines = lines.withColumn("line", F.regexp_replace("line", "\r+$", ""))
    if "dump" not in lines.columns:
        lines = lines.withColumn("dump", F.col("source_file"))
    lines = lines.withColumn("is_start", is_request_line(F.col("line")).cast("int"))
    if bom_files:
        first = (F.col("split_start") == 0) & (F.row_number().over(
            Window.partitionBy("source_file", "split_start").orderBy("mid")) == 1)
        bom = F.coalesce(F.try_parse_url(F.col("source_file"), F.lit("PATH")),
                         F.col("source_file")).isin(list(bom_files))
        lines = lines.withColumn("is_start", F.when(first & bom, F.lit(0)).otherwise(F.col("is_start")))
    return lines


def number_blocks(lines: DataFrame, strip_cr: bool = True, bom_files: Sequence[str] = (),
                  starts: DataFrame | None = None) -> DataFrame:
    """Give every line the number of its request block within its dump (0 = before the first).

    A running count of request-line starts inside each (file, split) — a window
    bounded by the split size — plus the count of starts in earlier splits and
    parts of the same dump, so a block may run over the edge of a split or part.
    """
    if "is_start" not in lines.columns:
        lines = mark_starts(lines, strip_cr, bom_files)
    in_split = Window.partitionBy("source_file", "split_start").orderBy("mid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("local_block", F.sum("is_start").over(in_split))
    offsets = (split_starts(lines) if starts is None else starts).select("source_file", "split_start", "offset")
    return (lines.join(offsets, ["source_file", "split_start"])
            .withColumn("block_no", (F.col("offset") + F.col("local_block")).cast("long"))
            .drop("offset", "local_block"))


def assemble_blocks(numbered: DataFrame) -> DataFrame:
    """(dump, source_file, block_no, lines[]) for every real block, lines in file order;
    ``source_file`` is the part in which the block begins."""
    grouped = (numbered.where(F.col("block_no") > 0)
               .groupBy("dump", "block_no")
               .agg(F.array_sort(F.collect_list(F.struct("source_file", "split_start", "mid", "line"))).alias("_l"))
               .select("dump", F.element_at("_l", 1)["source_file"].alias("source_file"), "block_no",
                       F.transform("_l", lambda x: x["line"]).alias("_all")))
    return grouped.withColumn("lines", strip_trailing_blanks(F.col("_all"))).drop("_all")


def parse_blocks(blocks: DataFrame, lines_col: str = "lines") -> DataFrame:
    """Block lines → request fields (method, target, version, headers, body, raw)."""
    return parse_block_df(blocks, lines_col)


def read_dump_files(spark: SparkSession, paths: Sequence[str] | str, label: int | Column = 0,
                    split: str = "", strip_cr: bool = True) -> DataFrame:
    """Parse dump files into the request schema (``pos`` = block order per file)."""
    if isinstance(paths, str):
        paths = [paths]
    bom = files_with_bom(spark, paths)
    blocks = assemble_blocks(number_blocks(read_dump_lines(spark, paths), strip_cr, bom))
    req = parse_blocks(blocks)
    lab = label if isinstance(label, Column) else F.lit(label)
    return req.select(
        (F.col("block_no") - 1).alias("pos"), "source_file", "block_no", "method", "target",
        "version", "headers", "body", "raw", lab.cast("int").alias("label"),
        F.lit(split).alias("split"))


def parse_dump_column(df: DataFrame, id_col: str, text_col: str, strip_cr: bool = True,
                      keep: Iterable[str] = ()) -> DataFrame:
    """S2/S3 for dumps held in a column: one output row per request block.

    Output: ``keep`` columns, ``id_col``, ``block_no`` (1-based per dump) and the
    parsed fields.
    """
    keep = list(keep)
    parts = F.split(F.col(text_col), REQUEST_BOUNDARY_RE, -1)
    exploded = df.select(*keep, id_col, F.posexplode(parts).alias("_i", "_text"),
                         is_request_line(F.element_at(parts, 1)).cast("int").alias("_first"))
    blocks = (exploded
              .where((F.col("_i") > 0) | (F.col("_first") == 1))
              .select(*keep, id_col, (F.col("_i") + F.col("_first")).cast("long").alias("block_no"),
                      "_text"))
    return parse_blocks(with_block_lines(blocks, F.col("_text"), strip_cr=strip_cr).drop("_text"))


def requests_from_raw(df: DataFrame, pos_col: str = "pos", raw_col: str = "raw",
                      label_col: str = "label", split: str = "", source: str = "") -> DataFrame:
    """One request per row whose ``raw`` text is exactly one block (derived views)."""
    base = df.select(F.col(pos_col).cast("long").alias("pos"), F.lit(source).alias("source_file"),
                     (F.col(pos_col) + 1).cast("long").alias("block_no"),
                     F.col(label_col).cast("int").alias("label"), F.lit(split).alias("split"),
                     F.col(raw_col).alias("_text"))
    parsed = parse_blocks(with_block_lines(base, F.col("_text")).drop("_text"))
    return parsed.select(*REQUEST_COLUMNS)


# ---------------------------------------------------------------- bundle

def manifest_status(spark: SparkSession, raw_dir: str, names: Sequence[str]) -> DataFrame:
    """(name, status) of the expected dumps, status ok, missing or empty.

    Metadata only (Hadoop FileSystem status / content summary), bounded by the
    number of expected dumps; a dump may be one file or a directory of parts.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{raw_dir.rstrip('/')}/{name}")
        fs = path.getFileSystem(conf)
        rows.append((name, "missing" if not fs.exists(path) else "empty" if fs.getContentSummary(path).getLength() == 0 else "ok"))
    return spark.createDataFrame(rows, "name string, status string")


def check_manifest(spark: SparkSession, raw_dir: str, names: Sequence[str]) -> None:
    """Every expected dump exists and is non-empty; the error names the path."""
    for name, status in manifest_status(spark, raw_dir, names).collect():
        if status == "missing":
            raise FileNotFoundError(f"request dump not found: {raw_dir.rstrip('/')}/{name}")
        if status == "empty":
            raise ValueError(f"request dump is empty: {raw_dir.rstrip('/')}/{name}")


def load_bundle(spark: SparkSession, raw_dir: str, files=CSIC_FILES, subset_fraction: float | None = None,
                subset_seed: int = 42, caps: dict | None = None, strip_cr: bool = True) -> DataFrame:
    """One read over all dumps → requests with ``split`` in {lm_train, inference}.

    A dump is a file or a directory of part files (read in name order, as one text:
    a request may run over the edge of a part).  ``pos`` restarts per view; inference
    lists normal then anomalous blocks (U1).  The tokenizer corpus is
    ``tokenizer_corpus(bundle)`` (U2).  Subsets (S7) are exact seeded samples per
    dump; caps (S8) keep the first N of each dump.  The requests per input split are
    counted in one light pass; all block, dump and view offsets derive from that table.
    """
    from ..operators.splits import keep_count, ordered_rank, sample_exact
    from ..session import cut_lineage

    check_manifest(spark, raw_dir, [f[0] for f in files])
    base = raw_dir.rstrip("/")
    paths = [f"{base}/{f[0]}" for f in files]
    lines = read_dump_lines(spark, paths)
    # the dump's number: its name is the file's or its folder's
    parts = F.split("source_file", "/")
    ordinal = F.lit(None).cast("int")
    for i, (name, _, _) in enumerate(files):
        ordinal = F.when((F.element_at(parts, -1) == name) | (F.element_at(parts, -2) == name), F.lit(i)).otherwise(ordinal)
    lines = mark_starts(lines.withColumn("dump", ordinal), strip_cr, files_with_bom(spark, paths))
    starts = cut_lineage(split_starts(lines))
    req = parse_blocks(assemble_blocks(number_blocks(lines, starts=starts))).withColumnRenamed("dump", "file_ord")
    req = req.withColumn("pos", F.col("block_no") - 1)
    if subset_fraction is not None:
        req = sample_exact(req, subset_fraction, subset_seed, key="pos", group_cols=("file_ord",))
    for name, cap in (caps or {}).items() if subset_fraction is None else ():
        ords = [i for i, f in enumerate(files) if f[0] == name]
        req = req.where(~F.col("file_ord").isin(ords) | (F.col("pos") < cap))
    if subset_fraction is not None:
        # sampling leaves gaps: renumber densely in file order (distributed rank)
        req = ordered_rank(req, "pos", group_cols=("file_ord",), out="pos")
    # positions restart per view: dump order, then block order (U1); one number per dump
    total = {r[0]: r[1] for r in starts.groupBy("dump").agg(F.sum("n_starts")).collect()}
    offset, seen = F.lit(0), {}
    label, role = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (name, lab, view) in enumerate(files):
        n = int(total.get(i) or 0)
        if subset_fraction is not None:
            n = min(n, keep_count(n, subset_fraction)) if n else 0
        elif name in (caps or {}):
            n = min(n, caps[name])
        offset = F.when(F.col("file_ord") == i, F.lit(seen.get(view, 0))).otherwise(offset)
        label = F.when(F.col("file_ord") == i, F.lit(lab)).otherwise(label)
        role = F.when(F.col("file_ord") == i, F.lit(view)).otherwise(role)
        seen[view] = seen.get(view, 0) + n
    req = req.select("*", label.alias("label"), role.alias("split")).withColumn("pos", (F.col("pos") + offset).cast("long"))
    return req.select(*REQUEST_COLUMNS)


def tokenizer_corpus(bundle: DataFrame) -> DataFrame:
    """lm_train ++ inference (duplicates kept), positions continue after lm_train."""
    n_lm = bundle.where(F.col("split") == "lm_train").agg(F.count("*")).first()[0]
    return bundle.withColumn(
        "pos", F.when(F.col("split") == "lm_train", F.col("pos")).otherwise(F.col("pos") + F.lit(n_lm))
    ).withColumn("split", F.lit("tokenizer_corpus"))


def load_structured(spark: SparkSession, path: str, fmt: str = "json", label: int | str = 0,
                    split: str = "", columns: dict | None = None) -> DataFrame:
    """Plug in another dataset — structured logs (JSON/CSV/Parquet) mapped to the request schema.

    ``columns`` maps schema fields to source columns (method, target, version,
    headers, body, label); headers may be an array of {name, value} structs or a
    ``Name: value`` newline-separated string.  Positions follow the source order
    by file name, place in the file and row (range-placed rank).
    """
    from ..functions.request import parse_header
    from ..operators.splits import ordered_rank

    m = {"method": "method", "target": "target", "version": "version", "headers": "headers", "body": "body"}
    m.update(columns or {})
    df = spark.read.format(fmt).load(path)
    types = dict(df.dtypes)

    def col(name, default=""):
        src = m.get(name)
        return F.coalesce(F.col(src).cast("string"), F.lit(default)) if src in types else F.lit(default)

    hsrc = m["headers"]
    if hsrc in types and types[hsrc].startswith("array"):
        headers = F.col(hsrc).cast("array<struct<name:string,value:string>>")
    elif hsrc in types:
        headers = F.transform(F.filter(F.split(F.col(hsrc), "\n"), lambda x: x != ""), parse_header)
    else:
        headers = F.array().cast("array<struct<name:string,value:string>>")
    headers = F.coalesce(headers, F.array().cast("array<struct<name:string,value:string>>"))
    lab = F.col(label).cast("int") if isinstance(label, str) else F.lit(label)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row"))  # ids rise inside a split only
    base = df.select(place.alias("_mid"), col("method").alias("method"),
                     col("target").alias("target"), col("version").alias("version"), headers.alias("headers"),
                     col("body").alias("body"), lab.alias("label"),
                     F.col("_metadata.file_path").alias("source_file"))
    base = ordered_rank(base, "_mid", out="pos")
    rl = F.array_join(F.filter(F.array("method", "target", "version"), lambda x: x != ""), " ")
    raw = F.array_join(F.concat(F.array(rl), F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "),
                                                                                         h["value"])),
                                F.filter(F.array(F.lit(""), F.col("body")), lambda x: x != "")), "\n")
    return base.select("pos", "source_file", (F.col("pos") + 1).alias("block_no"), "method", "target", "version",
                       "headers", "body", raw.alias("raw"), "label", F.lit(split).alias("split"))
