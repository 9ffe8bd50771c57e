"""Files into records: filters, fingerprints, dates, sidecars, change sets and sinks."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


col = F.col
# Extensions of pictures, raw pictures and videos that are taken in, and names of folders that are skipped.
PHOTO_EXTENSIONS = "jpg jpeg png heic heif webp tif tiff bmp gif nef cr2 cr3 arw dng orf rw2 pef rwl srw raf".split()
VIDEO_EXTENSIONS = "mp4 m4v mov webm mkv avi 3gp 3g2 mts m2ts".split()
SKIP_FOLDERS = [".photovault", ".Trash", "$RECYCLE.BIN", "System Volume Information", ".DS_Store", "Thumbs.db", ".thumbnails", "@eaDir"]
MIN_BYTES = 1024
HEAD_BYTES = 65536


def extension(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_type(path: str) -> Column:
    return F.when(extension(path).isin(VIDEO_EXTENSIONS), "video").otherwise("photo")


def wanted(path: str, size: str, hidden: bool = False) -> Column:
    """Known extensions of at least 1 KB outside skipped folders, and no hidden files unless asked for."""
    parts = F.split(path, "/")
    ok = extension(path).isin(PHOTO_EXTENSIONS + VIDEO_EXTENSIONS) & (col(size) >= MIN_BYTES) & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_FOLDERS)))
    return ok if hidden else ok & ~F.exists(parts, lambda p: p.startswith("."))


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder; content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)


def le8(c: Column) -> Column:
    """A long as 8 bytes, the lowest first."""
    h = F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def fast_fingerprint(size: Column, mtime: Column, content: Column) -> Column:
    """SHA-256 of size, time and the first 64 KB."""
    return F.sha2(F.concat(le8(size), le8(mtime), F.substring(content, 1, HEAD_BYTES)), 256)


def fresh(listing: DataFrame, known: DataFrame, path: str = "file_path") -> DataFrame:
    return listing.join(known.select(path), path, "left_anti")


def change_set(photos: DataFrame, listing: DataFrame) -> DataFrame:
    """(op, photo_id, file_path) that turns the photos (photo_id, file_path, file_size, mtime, file_hash) into the listing (file_path, size, mtime, file_hash).

    'moved': a missing file's content is at a new path; of the missing files with it the first is moved, to the first new path, and no path is used twice. Then
    'missing', 'added' (photo_id null), and 'modified' for another size or time.
    """
    gone = photos.join(listing.select("file_path"), "file_path", "left_anti")
    came = listing.join(photos.select("file_path"), "file_path", "left_anti")
    first_gone = gone.where("file_hash is not null").groupBy("file_hash").agg(F.min("photo_id").alias("photo_id"))
    first_came = came.where("file_hash is not null").groupBy("file_hash").agg(F.min("file_path").alias("file_path"))
    moved = first_gone.join(first_came, "file_hash").select(F.lit("moved").alias("op"), "photo_id", "file_path")
    missing = gone.join(moved.select("photo_id"), "photo_id", "left_anti").select(F.lit("missing").alias("op"), "photo_id", "file_path")
    added = came.join(moved.select("file_path"), "file_path", "left_anti").select(F.lit("added").alias("op"), F.lit(None).cast("long").alias("photo_id"), "file_path")
    new = listing.select("file_path", "size", col("mtime").alias("_mtime"))
    modified = photos.join(new, "file_path").where(~col("size").eqNullSafe(col("file_size")) | ~col("_mtime").eqNullSafe(col("mtime"))).select(F.lit("modified").alias("op"), "photo_id", "file_path")
    return moved.unionByName(missing).unionByName(added).unionByName(modified)


def applied(photos: DataFrame, changes: DataFrame, listing: DataFrame) -> DataFrame:
    """The photos after a change set: moved ones at their new path, missing ones trashed, modified ones with their new size and time and derived columns reset, added ones as stubs."""
    c = changes.where("op <> 'added'").select("photo_id", col("op").alias("_op"), col("file_path").alias("_new"))
    n = listing.select(col("file_path").alias("_new"), col("size").alias("_size"), col("mtime").alias("_time"))
    p = photos.join(c, "photo_id", "left").join(n, "_new", "left")
    is_ = lambda op: F.coalesce(col("_op") == op, F.lit(False))
    out = p.select(
        "photo_id", F.when(is_("moved"), col("_new")).otherwise(col("file_path")).alias("file_path"), F.when(is_("modified"), col("_size")).otherwise(col("file_size")).alias("file_size"),
        F.when(is_("modified"), col("_time")).otherwise(col("mtime")).alias("mtime"), F.when(is_("modified"), F.lit(None)).otherwise(col("taken")).alias("taken"), (col("trashed") | is_("missing")).alias("trashed"),
    )
    stubs = changes.where("op = 'added'").select(col("file_path").alias("_new")).join(n, "_new").select(F.lit(None).cast("long").alias("photo_id"), col("_new").alias("file_path"), col("_size").alias("file_size"), col("_time").alias("mtime"), F.lit(None).cast("timestamp_ntz").alias("taken"), F.lit(False).alias("trashed"))
    return out.unionByName(stubs)


# Notations of dates in file names, in order; digits in brackets are, one after the other, year, month, day, hour, minute and second.
NAME_DATES = [
    r"IMG_(\d{8})_(\d{6})",
    r"(\d{8})_(\d{6})",
    r"(\d{4}-\d{2}-\d{2}) (\d{2}\.\d{2}\.\d{2})",
    r"Screenshot_(\d{8})[-_](\d{6})",
    r"(?:IMG|VID)-(\d{8})-WA\d+",
    r"Screenshot[ _](\d{4}-\d{2}-\d{2}) at (\d{2}\.\d{2}\.\d{2})",
    r"signal-(\d{4}-\d{2}-\d{2})-(\d{6})",
    r"(\d{8})-(\d{6})",
    r"(\d{4}-\d{2}-\d{2})-(\d{2}-\d{2}-\d{2})",
    r"(\d{4}-\d{2}-\d{2})[ _](\d{2}[.\-_]\d{2}[.\-_]\d{2})",
    r"(?:^|[^\d])(\d{8})\.",
]


def name_date(name: str, last_year: int) -> Column:
    """The first plausible date in a file name, midnight where it has no time of day or one that doesn't exist; years from 1900 to ``last_year`` + 1."""
    out = []
    for p in NAME_DATES:
        digits = F.regexp_replace(F.concat(*(F.regexp_extract(name, p, i) for i in range(1, p.replace("(?:", "").count("(") + 1))), r"\D", "")
        part = lambda i, n, d=digits: F.substring(d, i, n)
        day = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
        whole = F.concat(day, F.lit(" "), F.concat_ws(":", part(9, 2), part(11, 2), part(13, 2))).try_cast("timestamp_ntz")
        for t in (F.when(F.length(digits) == 14, whole), F.when(F.length(digits) == 8, day.try_cast("date").cast("timestamp_ntz"))):
            out.append(F.when(F.year(t).between(1900, last_year + 1), t))
    return F.coalesce(*out)


def exif_date(text: str) -> Column:
    """A camera's date, whose clock is kept and whose zone is dropped."""
    t = F.regexp_replace(F.trim(F.translate(text, "\x00", "")), r"(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$", "")
    t = F.regexp_replace(t, r"^(\d{4})[:/](\d{2})[:/](\d{2})[T ]", "$1-$2-$3 ")
    return t.try_cast("timestamp_ntz")


def chosen_date(exif: str, digitized: str, name: str, meta: str, mtime: str, last_year: int) -> tuple[Column, Column]:
    """(date, source) by precedence: camera, digitised, file name, file metadata unless two or more years off the file's time, file's time."""
    e, d, n, m = exif_date(exif), exif_date(digitized), name_date(name, last_year), exif_date(meta)
    f = F.timestamp_seconds(mtime).cast("timestamp_ntz")
    m = F.when(F.abs(F.year(m) - F.coalesce(F.year(f), F.year(m))) < 2, m)
    order = [(e, "exif"), (d, "exif_digitized"), (n, "filename"), (m, "file_meta"), (f, "mtime")]
    source = F.lit(None).cast("string")
    for v, s in reversed(order):
        source = F.when(v.isNotNull(), s).otherwise(source)
    return F.coalesce(*(v for v, _ in order)), source


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds with N, S, E or W as signed degrees."""
    v = d + m / 60 + s / 3600
    return F.when(F.upper(ref).isin("S", "W"), -v).otherwise(v)


def tsv_cities(spark: SparkSession, cities: str, countries: str, people: int = 0) -> DataFrame:
    """Cities of a GeoNames-style table of 19 tab-separated columns, with country names; comments, short rows and byte-order marks are skipped."""
    line = spark.read.text(cities).select(F.regexp_replace("value", "^﻿", "").alias("v")).where(~col("v").startswith("#"))
    f = line.select(F.split("v", "\t").alias("f")).where(F.size("f") >= 18)
    c = f.select(
        col("f")[0].try_cast("long").alias("id"), col("f")[1].alias("name"), col("f")[2].alias("ascii_name"), col("f")[4].try_cast("double").alias("latitude"), col("f")[5].try_cast("double").alias("longitude"),
        col("f")[8].alias("country_code"), col("f")[14].try_cast("long").alias("population"), col("f")[7].alias("feature_code"), col("f")[17].alias("timezone"),
    ).where((col("population") >= people) & col("id").isNotNull())
    n = spark.read.text(countries).select(F.regexp_replace("value", "^﻿", "").alias("v")).where(~col("v").startswith("#"))
    n = n.select(F.split("v", "\t").alias("f")).where(F.size("f") >= 5).select(col("f")[0].alias("country_code"), col("f")[4].alias("_name"))
    return c.join(n, "country_code", "left").select("*", F.coalesce("_name", "country_code").alias("country_name")).drop("_name")


SIDECAR = "title string, description string, taken_at_unix string, latitude double, longitude double, favorited boolean"


def sidecars(items: DataFrame) -> DataFrame:
    """(content_hash, title, taken_text, lat, lon, favorited) of TakeoutMetadata objects; broken ones give nulls, a missing title the file's name, (0, 0) and impossible positions none."""
    m = items.withColumn("m", F.from_json("metadata_json", SIDECAR))
    ok = col("m.latitude").between(-90, 90) & col("m.longitude").between(-180, 180) & ~((F.abs("m.latitude") < 0.001) & (F.abs("m.longitude") < 0.001))
    return m.select("content_hash", F.coalesce("m.title", F.regexp_extract("file_path", "[^/]+$", 0)).alias("title"), col("m.taken_at_unix").alias("taken_text"), F.when(ok, col("m.latitude")).alias("lat"), F.when(ok, col("m.longitude")).alias("lon"), F.coalesce("m.favorited", F.lit(False)).alias("favorited"))


def year_folder(path: str) -> Column:
    """The year of a folder 'Photos from YYYY' in a path, or null."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)Photos from (\d{4})(?:/|$)", 1), F.lit("")).cast("int")


def folder_key(path: str) -> Column:
    """Folder and file name in lower case, without the extension of a sidecar."""
    return F.lower(F.regexp_replace(path, r"\.json$", ""))


def zip_inventory(files: DataFrame) -> DataFrame:
    """(archive, name, size, crc, is_sidecar) of the entries of ZIP archives (path, content), read from their directories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, e.filename, e.file_size, e.CRC, e.filename.lower().endswith(".json")) for e in zipfile.ZipFile(io.BytesIO(content or b"")).infolist() if not e.is_dir()]
                except zipfile.BadZipFile:
                    continue
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["archive", "name", "size", "crc", "is_sidecar"])

    return files.select("path", "content").mapInArrow(run, "archive string, name string, size long, crc long, is_sidecar boolean")


def folder_of(name: str) -> Column:
    """The album folder of an entry: the one that holds it, unless it is a year's folder or the export's own."""
    parent = F.regexp_extract(name, r"([^/]+)/[^/]+$", 1)
    return F.when((parent != "") & ~parent.rlike(r"^Photos from \d{4}$") & ~parent.isin("Takeout", "Google Photos"), parent)


def import_estimate(inventory: DataFrame) -> DataFrame:
    """One row for entries of archives: media, sidecars, bytes of media, albums, and media left when entries of one size and checksum count once (before anything is unpacked)."""
    m = ~col("is_sidecar")
    one = inventory.where(m).groupBy("size", "crc").agg(F.count("*").alias("_n"))
    repeats = one.agg(F.coalesce(F.sum(col("_n") - 1), F.lit(0)).alias("repeats"))
    album = inventory.where(m).select(folder_of("name").alias("_a")).agg(F.countDistinct("_a").alias("albums"))
    rest = inventory.agg(F.count_if(m).alias("media"), F.count_if(~m).alias("sidecars"), F.coalesce(F.sum(F.when(m, col("size"))), F.lit(0)).alias("bytes"))
    return rest.crossJoin(repeats).crossJoin(album)  # one row each


_EPOCH_1904 = datetime(1904, 1, 1)  # noqa: DTZ001


def quicktime_date(head: bytes) -> datetime | None:
    """The creation time in the first movie or media header of a QuickTime file, if it is plausible."""
    for atom in (b"mvhd", b"mdhd"):
        i = head.find(atom)
        if i < 0 or len(head) < i + 16:
            continue
        version = head[i + 4]
        seconds = struct.unpack(">Q", head[i + 8 : i + 16])[0] if version == 1 else struct.unpack(">I", head[i + 8 : i + 12])[0]
        if 2_082_844_800 < seconds < 1 << 33:  # from 1970 on
            return _EPOCH_1904 + timedelta(seconds=seconds)
    return None


_TEXT_DATE = re.compile(rb"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})")


def video_dates(files: DataFrame) -> DataFrame:
    """(path, taken) of videos (path, content): a written date in the first or last 64 KB, else the header's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c in b.column(1).to_pylist():
                ends = (c or b"")[:HEAD_BYTES] + (c or b"")[-HEAD_BYTES:]
                m = _TEXT_DATE.search(ends)
                try:
                    t = datetime(*map(int, m.groups())) if m else quicktime_date(ends)  # noqa: DTZ001
                except ValueError:
                    t = quicktime_date(ends)
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.timestamp("us"))], names=["path", "taken"])

    return files.select("path", "content").mapInArrow(run, "path string, taken timestamp_ntz")


def exif_tags(content: bytes) -> dict[str, object]:
    """make, model, date, iso, lat and lon of a JPEG's EXIF block; whatever is missing or broken is left out."""
    i = content.find(b"Exif\x00\x00")
    if i < 0:
        return {}
    t = content[i + 6 :]
    end = "<" if t[:2] == b"II" else ">"
    out: dict[str, object] = {}

    def entries(at: int) -> Iterator[tuple[int, int, int, bytes]]:
        (n,) = struct.unpack_from(end + "H", t, at)
        for k in range(min(n, 512)):
            tag, kind, count = struct.unpack_from(end + "HHI", t, at + 2 + 12 * k)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}.get(kind, 1) * count
            p = at + 10 + 12 * k
            if size > 4:
                (p,) = struct.unpack_from(end + "I", t, p)
            yield tag, kind, count, t[p : p + size]

    def rationals(v: bytes) -> list[float]:
        x = struct.unpack(end + "I" * (len(v) // 4), v)
        return [a / b if b else 0.0 for a, b in zip(x[::2], x[1::2])]

    text = lambda v: v.split(b"\x00")[0].decode("latin-1").strip()
    try:
        (first,) = struct.unpack_from(end + "I", t, 4)
        gps: dict[int, bytes] = {}
        for tag, _, _, v in entries(first):
            if tag in (0x010F, 0x0110):
                out["make" if tag == 0x010F else "model"] = text(v)
            elif tag == 0x8769:
                for tag2, kind2, _, v2 in entries(struct.unpack(end + "I", v)[0]):
                    if tag2 in (0x9003, 0x9004):
                        out["date" if tag2 == 0x9003 else "digitized"] = text(v2)
                    elif tag2 == 0x8827:
                        out["iso"] = struct.unpack(end + ("H" if kind2 == 3 else "I"), v2)[0]
            elif tag == 0x8825:
                gps = {tag2: v2 for tag2, _, _, v2 in entries(struct.unpack(end + "I", v)[0])}
        for name, ref, value in (("lat", 1, 2), ("lon", 3, 4)):
            if ref in gps and value in gps:
                d, m, s = rationals(gps[value])[:3]
                out[name] = (d + m / 60 + s / 3600) * (-1 if text(gps[ref]) in ("S", "W") else 1)
    except (struct.error, ValueError, RecursionError):
        return out
    return out


def exif(files: DataFrame) -> DataFrame:
    """(path, make, model, date, digitized, iso, lat, lon) of pictures (path, content)."""
    names = ["make", "model", "date", "digitized", "iso", "lat", "lon"]
    types = [pa.string()] * 4 + [pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tags = [exif_tags(c or b"") for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x.get(n) for x in tags], t) for n, t in zip(names, types))], names=["path", *names])

    return files.select("path", "content").mapInArrow(run, "path string, make string, model string, date string, digitized string, iso long, lat double, lon double")


def inserted(old: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """``old`` with the rows of ``new`` whose key it lacks; a second time nothing is added. Of equal keys in ``new`` one row is taken."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti").select(*old.columns))


def upserted(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """``old`` overwritten by ``new`` on the key; the columns ``keep`` are only filled in where they were null."""
    n = new.select(col(key), F.lit(True).alias("_there"), *[col(c).alias(f"_n_{c}") for c in old.columns if c != key])
    j = old.withColumn("_old", F.lit(True)).join(n, key, "full")
    out = []
    for c in old.columns:
        if c == key:
            out.append(col(c))
        elif c in keep:
            out.append(F.coalesce(c, f"_n_{c}").alias(c))
        else:
            out.append(F.when(col("_there"), col(f"_n_{c}")).otherwise(col(c)).alias(c))
    return j.select(*out)


def updated(photos: DataFrame, updates: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(photos, refused): updates apply only where id and file_hash are still the same; the others are refused and kept apart."""
    u = updates.select("photo_id", col("file_hash").alias("_h"), *[col(c).alias(f"_u_{c}") for c in columns])
    j = photos.join(u, "photo_id", "left")
    ok = F.coalesce(col("_h") == col("file_hash"), F.lit(False))
    fresh_ = j.select(*[F.when(ok, F.coalesce(f"_u_{c}", c)).otherwise(col(c)).alias(c) if c in columns else col(c) for c in photos.columns])
    refused = updates.join(photos.select("photo_id", "file_hash"), ["photo_id", "file_hash"], "left_anti")
    return fresh_, refused


def known_vectors(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """An append-only vector store: the last written vector of each key."""
    u = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return u.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(col("_v").desc()))).where("_r = 1").drop("_v", "_r")


def metadata(text: str | None) -> dict[str, object]:
    """A TakeoutMetadata object, or nothing if it is broken."""
    try:
        o = json.loads(text) if text else {}
    except ValueError:
        return {}
    return o if isinstance(o, dict) else {}


