"""Intake: uploads, names, formats, archives, documents, text decoding; packages as sinks."""

from __future__ import annotations

import io
import itertools
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import natural_key

MB = 1024 * 1024
#: Byte caps by extension.
LIMITS = {"zip": 80 * MB, "pdf": 64 * MB, "docx": 64 * MB}
OTHER_LIMIT = 25 * MB
BATCH_FILES, BATCH_BYTES = 200, 80 * MB


def decode_upload(uploads: DataFrame, data: str, most: int = OTHER_LIMIT) -> DataFrame:
    """Strict base64 (length, alphabet, round trip) up to a cap; refused rows carry a reason and no bytes."""
    text = F.col(data)
    shaped = (F.length(text) % 4 == 0) & text.rlike(r"^[A-Za-z0-9+/]*={0,2}$")
    raw = F.when(shaped, F.try_to_binary(text, F.lit("base64")))
    back = F.regexp_replace(F.base64(raw), r"\s", "")
    reason = F.when(raw.isNull() | (back != text), "not base64").when(F.length(raw) > most, "too large")
    return uploads.withColumn("reason", reason).withColumn("bytes", F.when(reason.isNull(), raw))


def safe_relative_name(name: Column) -> Column:
    """Forward slashes; null for absolute, drive, special, dotted, empty or overlong names."""
    n = F.regexp_replace(name, r"\\", "/")
    bad = (F.length(n) > 400) | (F.length(n) == 0) | n.rlike(r"^/|^[A-Za-z]:|[?#:]|[\x00-\x1F\x7F]") | F.exists(F.split(n, "/"), lambda p: p.isin("", ".", ".."))
    return F.when(~bad, n)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def input_limit(name: Column) -> Column:
    out = F.lit(OTHER_LIMIT)
    for ext, cap in LIMITS.items():
        out = F.when(extension(name) == ext, cap).otherwise(out)
    return out


#: Leading bytes of media formats (hex, offset from 1).
MAGIC = (
    ("png", "image", 1, "89504E470D0A1A0A"), ("jpeg", "image", 1, "FFD8FF"), ("gif", "image", 1, "47494638"), ("mp3", "audio", 1, "494433"), ("ogg", "audio", 1, "4F676753"), ("webm", "video", 1, "1A45DFA3"),
)
#: Formats of extensions.
FORMAT_OF = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "webp": "webp", "wav": "wav", "mp3": "mp3", "ogg": "ogg", "webm": "webm", "avif": "avif", "mp4": "mp4", "m4a": "mp4"}


def detect_media(content: Column) -> Column:
    """struct(format, kind) by leading bytes, null for others."""
    head = F.hex(F.substring(content, 1, 16))
    fmt, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    riff = F.substring(head, 1, 8) == "52494646"
    brand = F.substring(head, 9, 8) == "66747970"
    tests = [(F.substring(head, 2 * at - 1, len(h)) == h, f, k) for f, k, at, h in MAGIC]
    tests += [(riff & (F.substring(head, 17, 8) == "57454250"), "webp", "image"), (riff & (F.substring(head, 17, 8) == "57415645"), "wav", "audio")]
    tests += [(brand & (F.substring(head, 17, 8) == "61766966"), "avif", "image"), (brand & (F.substring(head, 17, 8) != "61766966"), "mp4", "video"), (head.rlike("^FF[EF][23ABF]"), "mp3", "audio")]
    for cond, f, k in reversed(tests):
        fmt, kind = F.when(cond, f).otherwise(fmt), F.when(cond, k).otherwise(kind)
    return F.when(fmt.isNotNull(), F.struct(fmt.alias("format"), kind.alias("kind")))


def identify_media(name: Column, content: Column) -> Column:
    """The detected format where it agrees with the extension, else null."""
    expected = F.lit(None).cast("string")
    for ext, f in FORMAT_OF.items():
        expected = F.when(extension(name) == ext, f).otherwise(expected)
    found = detect_media(content)["format"]
    return F.when(found == expected, found)


ARCHIVE = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("name", T.StringType()), ("size", T.LongType()), ("content", T.BinaryType()), ("issue", T.StringType()))])


def _members(path: str, content: bytes, most: int) -> Iterator[tuple]:
    """Members of one archive; it is refused whole before the first byte is read if any entry is unfit."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        infos = [i for i in archive.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, ValueError) as e:
        yield path, None, None, None, f"not an archive: {type(e).__name__}"
        return
    folded = [unicodedata.normalize("NFC", i.filename).lower() for i in infos]
    names = set(folded)
    total = sum(i.file_size for i in infos)
    issue = None
    if total > most:
        issue = "too large"
    elif any(i.flag_bits & 1 for i in infos):
        issue = "encrypted"
    elif len(names) < len(folded):
        issue = "duplicate names"
    elif any(n.startswith(("/", "../")) or "/../" in n or re.match("[a-z]:", n) for n in folded):
        issue = "unsafe name"
    elif any("/".join(n.split("/")[:k]) in names for n in folded for k in range(1, n.count("/") + 1)):
        issue = "file and folder of one name"
    elif any((i.external_attr >> 16) & 0o170000 == 0o120000 for i in infos):
        issue = "symbolic link"
    elif any(i.file_size > 100 * max(1, i.compress_size) and i.file_size > MB for i in infos):
        issue = "suspicious ratio"
    if issue:
        yield path, None, None, None, issue
        return
    for i in infos:
        try:
            yield path, i.filename, i.file_size, archive.read(i), None
        except (zipfile.BadZipFile, zlib.error, NotImplementedError) as e:
            yield path, i.filename, None, None, f"damaged: {type(e).__name__}"
            return  # a failed entry uses up the archive


#: Members that are put out at once.
MEMBERS = 1000


def read_archives(files: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """Members of ZIP files (path, content, as spark.read.format("binaryFile") gives), one row each; issues as rows."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("issue", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                members = _members(path.as_py(), content.as_py() or b"", most)
                while rows := list(itertools.islice(members, MEMBERS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, ARCHIVE)


def zip_bytes(entries: Iterable[tuple[str, bytes]]) -> bytes:
    """A deterministic ZIP of entries sorted by name, taken one at a time: fixed times, no overwriting."""
    out, before = io.BytesIO(), None
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            if name == before:
                raise ValueError("duplicate name")
            before = name
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def package_archives(entries: DataFrame, by: str) -> DataFrame:
    """One ZIP per package (by, name, content) with the hash of its bytes; entries come sorted and are written as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, held in itertools.groupby(rows, lambda r: r[0]):
            data = zip_bytes((name, content) for _, name, content in held)
            yield pa.RecordBatch.from_arrays([pa.array([str(key)]), pa.array([data], pa.binary())], [by, "zip"])

    dealt = entries.select(by, "name", "content").repartition(by).sortWithinPartitions(by, "name")
    return dealt.mapInArrow(run, f"`{by}` string, zip binary").withColumn("sha256", F.sha2("zip", 256))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraphs and table rows (cells parted by tabs) of a DOCX, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}p":
            out.append(text(node))
        elif node.tag == f"{_W}tbl":
            out += ["\t".join(text(cell) for cell in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def docx_text(contents: pd.Series) -> pd.Series:
    def read(c):
        try:
            return docx_paragraphs(bytes(c))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None

    return contents.map(read)


@F.pandas_udf(T.StringType())
def decode_text(contents: pd.Series) -> pd.Series:
    """UTF-16 with a byte order mark, else strict UTF-8; null where it is neither."""

    def read(c):
        if c is None:
            return None
        c = bytes(c)
        try:
            if c[:2] in (b"\xff\xfe", b"\xfe\xff"):
                return c.decode("utf-16")
            return c.decode("utf-8-sig")
        except UnicodeDecodeError:
            return None

    return contents.map(read)


def readable(text: Column) -> Column:
    return text.isNotNull() & ~text.rlike(r"[\x00-\x08\x0E-\x1F]")


def batch_guards(files: DataFrame, batch: str) -> DataFrame:
    """Per batch: number of files, bytes, manifests, repeated folded names, and whether it passes."""
    folded = F.lower(F.col("name"))
    g = files.groupBy(batch).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(folded.rlike(r"(^|/)manifest\.json$")).alias("manifests"), (F.count("*") - F.count_distinct(folded)).alias("repeated"))
    return g.withColumn("ok", (F.col("files") <= BATCH_FILES) & (F.col("bytes") <= BATCH_BYTES) & (F.col("manifests") <= 1) & (F.col("repeated") == 0))


def strip_wrapper(files: DataFrame, batch: str) -> DataFrame:
    """Names without the folder that all files of a batch stand in, if there is one."""
    top = F.when(F.contains("name", F.lit("/")), F.substring_index("name", "/", 1))
    w = Window.partitionBy(batch)
    one = (F.min(top).over(w) == F.max(top).over(w)) & (F.count(top).over(w) == F.count("*").over(w))
    return files.withColumn("name", F.when(one, F.expr("substring(name, length(substring_index(name, '/', 1)) + 2)")).otherwise(F.col("name")))


def tolerant_intake(files: DataFrame, batch: str) -> DataFrame:
    """Archive members commit as a unit; loose files on their own."""
    unit = F.coalesce(F.col("archive"), F.concat(F.lit("file:"), F.col("name")))
    return files.withColumn("kept", F.min(F.col("ok").cast("int")).over(Window.partitionBy(batch, unit)) == 1)


def canonical_names(files: DataFrame, scope: list[str]) -> DataFrame:
    """Unique media names in natural order: a name taken already gets twelve digits of its hash, then a counter."""
    w = Window.partitionBy(*scope, F.lower("name")).orderBy(natural_key(F.col("name")), "sha256")
    t = files.withColumn("_n", F.row_number().over(w))
    w2 = Window.partitionBy(*scope, F.lower("name"), F.substring("sha256", 1, 12)).orderBy("_n")
    t = t.withColumn("_k", F.row_number().over(w2))
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[A-Za-z0-9]+)?$", 1), F.regexp_extract("name", r"(\.[A-Za-z0-9]+)$", 1)
    suffix = F.concat(F.lit("-"), F.substring("sha256", 1, 12), F.when(F.col("_k") > 1, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise(""))
    return t.withColumn("canonical", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat(stem, suffix, ext))).drop("_n", "_k")


def source_texts(chunks: DataFrame, by: list[str], order: list[str], most_chars: int = 500_000) -> DataFrame:
    """Text of each source from its chunks in order, with whether it is within the cap."""
    parts = F.sort_array(F.collect_list(F.struct(*order, "text")))
    t = chunks.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
    return t.withColumn("chars", F.length("text")).withColumn("ok", F.col("chars") <= most_chars)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """JSON packages, one per file, as VARIANT."""
    return spark.read.format("binaryFile").load(path).select("path", F.parse_json(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")).alias("pack"))
