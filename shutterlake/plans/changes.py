"""Queries of sources, sinks, mutations and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions import exprs as X
from shutterlake.functions.cameras import device_names
from shutterlake.operators import grouping as G
from shutterlake.operators import ingest as N
from shutterlake.operators import mutate as M
from shutterlake.plans.groups import _EX, _OPS, changes, sized
from shutterlake.plans.timeline import _ST, stacks
from shutterlake.session import fresh
from shutterlake.sources.library import Library, sql
from shutterlake.streaming import library as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
col = F.col


def q(name: str, text: str | None, f, more: str = "") -> None:  # noqa: ANN001
    QUERIES[name] = lambda spark, d: f(Library(spark, d))
    if text:
        SQL[name] = sql(text, more)


_EXT = "lower(regexp_extract(file_path, '\\.([^./\\\\]+)$', 1))"
_VIDEOS = "'mp4', 'm4v', 'mov', 'webm', 'mkv', 'avi', '3gp', '3g2', 'mts', 'm2ts'"
q("SC01", None, lambda L: N.listed(L.spark, L.path).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length").where("name like '%.parquet'"))
q("SC02", f"SELECT photo_id FROM ph WHERE {_EXT} IN ('jpg', 'jpeg', 'png', 'heic', 'heif', 'webp', 'tif', 'tiff', 'bmp', 'gif', 'nef', 'cr2', 'cr3', 'arw', 'dng', 'orf', 'rw2', 'pef', 'rwl', 'srw', 'raf', {_VIDEOS}) AND file_size >= 1024 AND NOT list_has_any(string_split(file_path, '/'), ['$RECYCLE.BIN', 'System Volume Information', 'Thumbs.db', '@eaDir']) AND NOT regexp_matches(file_path, '(^|/)[.]')", lambda L: L.photos().where(N.wanted("file_path", "file_size")).select("photo_id"))
q("SC03", f"SELECT photo_id, CASE WHEN {_EXT} IN ({_VIDEOS}) THEN 'video' ELSE 'photo' END AS kind FROM ph", lambda L: L.photos().select("photo_id", N.media_type("file_path").alias("kind")))
_LE = " || ".join(f"substr(h{{}}, {i}, 2)" for i in range(15, 0, -2))
q("SC04", f"SELECT doc_id, sha256(unhex({_LE.replace('h{}', 'ha')} || {_LE.replace('h{}', 'hb')}) || t[1:65536]) AS fingerprint FROM (SELECT doc_id, lpad(hex(n_chars), 16, '0') AS ha, lpad(hex(doc_id), 16, '0') AS hb, encode(text) AS t FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL)", lambda L: L.table("documents").where("text is not null and n_chars is not null").select("doc_id", N.fast_fingerprint(col("n_chars"), col("doc_id"), F.encode("text", "utf-8")).alias("fingerprint")))
q("SC05", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL", lambda L: L.table("documents").where("text is not null").select("doc_id", F.sha2(F.encode("text", "utf-8"), 256).alias("content_hash")))
q("SC06", "SELECT file_path FROM items WHERE file_path NOT IN (SELECT file_path FROM ph)", lambda L: N.fresh(L.items().where("file_path is not null").select("file_path"), L.photos()))


def _named_by_date(L: Library) -> DataFrame:
    """Dated photos with a file name as phones and programs write it."""
    kinds = ["'IMG_'yyyyMMdd_HHmmss'.jpg'", "'Screenshot_'yyyyMMdd-HHmmss'.png'", "yyyy-MM-dd HH.mm.ss'.jpg'", "'signal-'yyyy-MM-dd-HHmmss'.jpg'", "'IMG-'yyyyMMdd'-WA0001.jpg'"]
    name = F.element_at(F.array(*(F.date_format("taken", k) for k in kinds)), (col("photo_id") % 5 + 1).cast("int"))
    return L.photos().where("taken is not null and year(taken) between 1900 and 2026").withColumn("name", name)


def _dates(L: Library) -> DataFrame:
    """The date and its source, of photos that have one to five of the sources."""
    p = _named_by_date(L).withColumn("k", col("photo_id") % 7)
    text = lambda k: F.when(col("k") == k, F.date_format("taken", "yyyy:MM:dd HH:mm:ss"))
    p = p.withColumns({"exif": text(0), "digitized": F.when(col("k") <= 1, F.date_format("taken", "yyyy:MM:dd HH:mm:ss")), "own": F.when(col("k") <= 2, col("name")).otherwise("clip.mov"), "meta": F.when(col("k") == 3, F.date_format(F.timestamp_seconds("mtime"), "yyyy:MM:dd HH:mm:ss")).when(col("k") == 4, "1931:01:01 00:00:00")})
    d, s = N.chosen_date("exif", "digitized", "own", "meta", "mtime", 2025)
    return p.select("photo_id", d.alias("taken"), s.alias("source"))


_NAMED = "dated AS (SELECT photo_id, taken, mtime, photo_id % 7 AS k, CASE WHEN photo_id % 5 = 4 THEN date_trunc('day', taken)::TIMESTAMP ELSE date_trunc('second', taken) END AS named FROM ph WHERE year(taken) BETWEEN 1900 AND 2026)"
q("SC09", "SELECT photo_id, CASE WHEN k <= 1 THEN taken WHEN k = 2 THEN named WHEN k = 4 AND mtime IS NULL THEN TIMESTAMP '1931-01-01' ELSE make_timestamp(mtime * 1000000) END AS taken, CASE WHEN k = 0 THEN 'exif' WHEN k = 1 THEN 'exif_digitized' WHEN k = 2 THEN 'filename' WHEN k = 3 AND mtime IS NOT NULL OR k = 4 AND mtime IS NULL THEN 'file_meta' WHEN mtime IS NOT NULL THEN 'mtime' END AS source FROM dated", lambda L: _dates(L), _NAMED)
q("SC10", "SELECT photo_id, named AS taken FROM dated", lambda L: _named_by_date(L).select("photo_id", N.name_date("name", 2025).alias("taken")), _NAMED)
q("SC11", "SELECT id AS photo_id, any_value(try_cast(substr(t, 1, 4) || '-' || substr(t, 6, 2) || '-' || substr(t, 9, 2) || ' ' || substr(t, 12) AS TIMESTAMP)) AS taken FROM (SELECT id, regexp_replace(trim(replace(date_taken, chr(0), '')), '(\\.\\d+)?\\s*(Z|[+-]\\d{2}:?\\d{2})?$', '') AS t FROM photos WHERE regexp_matches(trim(date_taken), '^\\d{4}[:]\\d{2}[:]\\d{2} \\d{2}:\\d{2}:\\d{2}')) GROUP BY id", lambda L: L.table("photos").where(F.trim("date_taken").rlike(r"^\d{4}[:]\d{2}[:]\d{2} \d{2}:\d{2}:\d{2}")).select(col("id").alias("photo_id"), N.exif_date("date_taken").alias("taken")).dropDuplicates(["photo_id"]))
q("SC15", "SELECT code, max(CASE WHEN starts_with(lower(model), lower(make)) THEN model ELSE make || ' ' || model END) AS name FROM (SELECT upper(trim(model)) AS code, trim(make) AS make, trim(model) AS model FROM camera_catalog WHERE trim(model) <> '' AND make IS NOT NULL) GROUP BY code", lambda L: _devices(L))


def _devices(L: Library) -> DataFrame:
    """The catalog written as a list of devices, and read back."""
    at = fresh(L.spark, "devices")
    c = L.table("camera_catalog").where("make is not null")
    c.select(col("make").alias("retail_branding"), col("model").alias("marketing_name"), F.lit("").alias("device"), "model").write.option("header", True).csv(at)
    return device_names(L.spark.read.csv(at, header=True, schema="retail_branding string, marketing_name string, device string, model string"))


_JS = "js AS (SELECT content_hash, file_path, try_cast(metadata_json AS JSON) AS j FROM items)"
_OKJ = "CAST(j ->> 'latitude' AS DOUBLE) BETWEEN -90 AND 90 AND CAST(j ->> 'longitude' AS DOUBLE) BETWEEN -180 AND 180 AND NOT (abs(CAST(j ->> 'latitude' AS DOUBLE)) < 0.001 AND abs(CAST(j ->> 'longitude' AS DOUBLE)) < 0.001)"
q("SC17", f"SELECT content_hash, coalesce(j ->> 'title', regexp_extract(file_path, '[^/]+$', 0)) AS title, CASE WHEN {_OKJ} THEN CAST(j ->> 'latitude' AS DOUBLE) END AS lat, CASE WHEN {_OKJ} THEN CAST(j ->> 'longitude' AS DOUBLE) END AS lon, coalesce(CAST(j ->> 'favorited' AS BOOLEAN), false) AS favorited FROM js WHERE j IS NOT NULL", lambda L: N.sidecars(L.items().where(F.try_parse_json("metadata_json").isNotNull())).drop("taken_text"), _JS)
q("SC18", "SELECT photo_id, CAST(nullif(regexp_extract(file_path, '(?:^|/)Photos from (\\d{4})(?:/|$)', 1), '') AS INTEGER) AS year, lower(regexp_replace(file_path, '\\.json$', '')) AS key FROM ph", lambda L: L.photos().select("photo_id", N.year_folder("file_path").alias("year"), N.folder_key("file_path").alias("key")))
q("SC19", "SELECT face_id AS id, round(CAST(e[1] AS DOUBLE) * CASE WHEN face_id % 2 = 0 THEN 2 ELSE 1 END, 6) AS first FROM (SELECT face_id, any_value(embedding) AS e FROM cluster_input GROUP BY face_id) WHERE len(e) = 64", lambda L: _stored_vectors(L))


def _stored_vectors(L: Library) -> DataFrame:
    """A vector store to which the vectors of every other face were appended again, doubled."""
    old = L.vectors().where(F.size("embedding") == 64).select(col("face_id").alias("id"), "embedding")
    new = old.where("id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
    return N.known_vectors(old, new).select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))



q("SK01", "SELECT file_path FROM ph UNION SELECT file_path FROM items WHERE file_path IS NOT NULL", lambda L: N.inserted(L.photos().select("file_path"), L.items().where("file_path is not null").select("file_path")))
_UP = "nw AS (SELECT file_path, 7::BIGINT AS file_size, 'Newtown' AS city FROM ph WHERE photo_id % 4 = 0 UNION ALL SELECT 'new/' || file_path, 7, 'Newtown' FROM ph WHERE photo_id % 9 = 0)"


def _upserts(L: Library) -> DataFrame:
    p = L.photos()
    old = p.where("photo_id % 4 = 0").select("file_path")
    new = p.where("photo_id % 9 = 0").select(F.concat(F.lit("new/"), "file_path").alias("file_path"))
    return N.upserted(p.select("file_path", "file_size", "city"), old.unionByName(new).select("file_path", F.lit(7).cast("long").alias("file_size"), F.lit("Newtown").alias("city")), "file_path", ["city"])


q("SK02", "SELECT coalesce(p.file_path, n.file_path) AS file_path, CASE WHEN n.file_path IS NOT NULL THEN n.file_size ELSE p.file_size END AS file_size, coalesce(p.city, n.city) AS city FROM ph p FULL JOIN nw n ON n.file_path = p.file_path", _upserts, _UP)


def _update(L: Library, refused: bool) -> DataFrame:
    p = L.photos().select("photo_id", "file_hash", "iso")
    u = p.where("photo_id % 5 = 0").select("photo_id", F.when(col("photo_id") % 15 == 0, "changed").otherwise(col("file_hash")).alias("file_hash"), F.lit(50).alias("iso"))
    a, b = N.updated(p, u, ["iso"])
    return b.select("photo_id") if refused else a.select("photo_id", "iso")


q("SK03", "SELECT photo_id, CASE WHEN photo_id % 5 = 0 AND photo_id % 15 <> 0 AND file_hash IS NOT NULL THEN 50 ELSE iso END AS iso FROM ph", lambda L: _update(L, False))
q("SK03_refused", "SELECT photo_id FROM ph WHERE photo_id % 15 = 0 OR (photo_id % 5 = 0 AND file_hash IS NULL)", lambda L: _update(L, True))
q("SK04", "SELECT row_number() OVER (ORDER BY a.added_at NULLS LAST, photo_id) AS position, photo_id, l.file_path FROM album_photos a JOIN live l USING (photo_id) WHERE a.album = 'Scans'", lambda L: M.exported(L.album_photos(), L.live(), "Scans"))

_T50 = lambda L: L.photos().where("photo_id % 50 = 0").select("photo_id")
q("DM01", "SELECT photo_id, trashed OR photo_id % 50 = 0 AS trashed, CASE WHEN NOT trashed AND photo_id % 50 = 0 THEN TIMESTAMP '2025-06-15 12:00:00' ELSE trashed_at END AS trashed_at FROM ph", lambda L: M.trashed(M.trashed(L.photos(), _T50(L), "2025-06-15 12:00:00"), _T50(L), "2025-06-16 12:00:00").select("photo_id", "trashed", "trashed_at"))
q("DM01_restore", "SELECT photo_id, trashed AND photo_id % 50 <> 0 AS trashed FROM ph", lambda L: M.restored(L.photos(), _T50(L)).select("photo_id", "trashed"))
q("DM02", "SELECT 'photos' AS t, count(*) AS n FROM ph WHERE NOT trashed UNION ALL SELECT 'faces', count(*) FROM faces WHERE photo_id NOT IN (SELECT photo_id FROM ph WHERE trashed) OR photo_id IS NULL UNION ALL SELECT 'albums', count(*) FROM album_photos WHERE photo_id NOT IN (SELECT photo_id FROM ph WHERE trashed)", lambda L: _deleted(L))


def _deleted(L: Library) -> DataFrame:
    out = None
    for name, t in zip(("photos", "faces", "albums"), M.deleted(L.photos().where("trashed"), L.photos(), L.faces(), L.album_photos())):
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = n if out is None else out.unionByName(n)
    return out


q("DM03", "SELECT album, count(*) AS n FROM (SELECT CASE WHEN album = 'School' THEN 'Lessons' ELSE album END AS album, photo_id FROM album_photos WHERE album <> 'Scans' AND NOT (album = 'Shared' AND photo_id % 2 = 0) UNION SELECT 'Grandparents', photo_id FROM live WHERE photo_id % 50 = 0) GROUP BY album", lambda L: M.renamed_album(M.added_to_album(M.removed_from_album(M.deleted_album(L.album_photos(), "Scans"), "Shared", L.photos().where("photo_id % 2 = 0")), "Grandparents", _T50(L), L.live(), "2025-06-15"), "School", "Lessons").groupBy("album").agg(F.count("*").alias("n")))
_S3 = f"{_ST}, keep AS (SELECT photo_id, stack FROM stacks WHERE photo_id % 3 <> 0), k2 AS (SELECT *, count(*) OVER (PARTITION BY stack) AS k, min(photo_id) OVER (PARTITION BY stack) AS first_id, max(photo_id) OVER (PARTITION BY stack) AS last_id FROM keep)"
q("DM04", "SELECT photo_id, stack, last_id AS cover FROM k2 WHERE k > 1", lambda L: _stacks(L), _S3)


def _stacks(L: Library) -> DataFrame:
    """Stacks after a third of the photos left, with the last photo as the cover that the user chose."""
    live = L.live().where("photo_id % 3 <> 0")
    s = stacks(L)
    covers = s.join(live, "photo_id", "left_semi").groupBy("stack").agg(F.max("photo_id").alias("cover"))
    return M.recovered_stacks(s, live, covers)


_KP = " + ".join(f"100 * CAST(list_contains(string_split_regex(lower(file_path), '[^a-z0-9]+'), '{w}') AS INTEGER)" for w in G.BAD_WORDS)
q("DM05", f"SELECT photo_id FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY {_KP}, file_size DESC, length(file_path), taken NULLS LAST, file_path, photo_id) AS rn FROM exact) WHERE rn > 1 AND NOT starts_with(file_hash, 'a')", lambda L: _to_trash(L), _EX)


def _to_trash(L: Library) -> DataFrame:
    g = G.exact_groups(sized(L))
    keeps = G.keep_suggestions(g).withColumnRenamed("file_hash", "group_key")
    groups = g.select(col("file_hash").alias("group_key"), "photo_id")
    return M.non_keepers(groups, keeps, groups.where(col("group_key").startswith("a")).select("group_key").distinct())


q("DM06", "SELECT photo_id FROM ph WHERE file_path <> 'Trips' AND NOT starts_with(file_path, 'Trips/')", lambda L: M.without_folder(L.photos(), "Trips").select("photo_id"))
_TK = f"{_JS}, led AS (SELECT file_path, CASE WHEN {_OKJ} THEN CAST(j ->> 'latitude' AS DOUBLE) END AS la, CASE WHEN {_OKJ} THEN CAST(j ->> 'longitude' AS DOUBLE) END AS lo, coalesce(CAST(j ->> 'favorited' AS BOOLEAN), false) AS f FROM js WHERE j IS NOT NULL)"
q("DM07", "SELECT photo_id, coalesce(la, lat) AS lat, coalesce(lo, lon) AS lon, favorite OR coalesce(f, false) AS favorite FROM ph LEFT JOIN led ON led.file_path = ph.file_path", lambda L: _applied(L), _TK)


def _applied(L: Library) -> DataFrame:
    s = N.sidecars(L.items().where(F.try_parse_json("metadata_json").isNotNull())).join(L.items().select("content_hash", "file_path"), "content_hash")
    return M.takeout_applied(L.photos(), s.withColumn("taken", F.lit(None).cast("timestamp_ntz"))).select("photo_id", "lat", "lon", "favorite")


q("DM08", "SELECT face_id AS id, CASE WHEN face_id % 4 = 0 THEN 'unsupported' WHEN face_id % 3 = 0 THEN 'failed' ELSE 'indexed' END AS status FROM faces", lambda L: M.index_state(L.faces().select(col("face_id").alias("id"), F.lit("failed").alias("status"), F.when(col("face_id") % 4 == 0, 2).otherwise(0).alias("attempts")), L.faces().select(col("face_id").alias("id"), ((col("face_id") % 3 != 0) & (col("face_id") % 4 != 0)).alias("ok"))).select("id", "status"))
q("TS09_apply", "SELECT file_path, trashed OR op IS NOT DISTINCT FROM 'missing' AS trashed FROM (SELECT CASE WHEN op = 'moved' THEN o.file_path ELSE p.file_path END AS file_path, trashed, op FROM ph p LEFT JOIN ops o ON o.photo_id = p.photo_id) UNION ALL SELECT file_path, false FROM ops WHERE op = 'added'", lambda L: N.applied(L.photos(), changes(L), X.later(L)).select("file_path", "trashed"), _OPS)

# Streams
_EVS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


def _events(L: Library) -> DataFrame:
    return S.tables(L.spark, f"{L.path}/events*.parquet", L.table("events")).select("event_id", col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


q("ST01_windows", _EVS, lambda L: S.collected(S.windows(_events(L), "ts", "10 minutes", "1 hour", ["event_type"]), "complete").select(col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"))
q("ST02_sessions", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM (SELECT *, sum(s) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) <= INTERVAL 4 MINUTE THEN 0 ELSE 1 END AS s FROM events)) GROUP BY event_type, session", lambda L: _sessions(L))


def _sessions(L: Library) -> DataFrame:
    """Sessions of each event type with their first event, as a stream closes them."""
    w = F.session_window("ts", "4 minutes").alias("w")
    e = _events(L).withWatermark("ts", "1 minute").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return S.collected(e.select("event_type", "n", "first_id"), "complete")


# Readers of files: the tables are written as such files first, then read whole
def _be4(c: F.Column) -> F.Column:
    return F.unhex(F.lpad(F.hex(c), 8, "0"))


def _block(make: str, model: str, date: str | None, iso: int | None, lat: tuple | None, lon: tuple | None) -> bytes:
    """An EXIF block, the highest byte first: maker and model, a directory of date and speed, and one of the position in degrees, minutes and hundredths of seconds."""
    import struct

    def directory(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
        heads, data, free = b"", b"", at + 2 + 12 * len(entries) + 4
        for tag, kind, count, v in entries:
            heads += struct.pack(">HHI", tag, kind, count) + (v.ljust(4, b"\0") if len(v) <= 4 else struct.pack(">I", free + len(data)))
            data += v if len(v) > 4 else b""
        return struct.pack(">H", len(entries)) + heads + struct.pack(">I", 0) + data

    text = lambda tag, v: (tag, 2, len(v) + 1, v + b"\0")
    own = [text(0x010F, make.encode("latin-1")), text(0x0110, model.encode("latin-1"))]
    shot = ([text(0x9003, date.encode())] if date else []) + ([(0x8827, 3, 1, struct.pack(">H", iso))] if iso is not None else [])
    place = []
    for k, v in ((1, lat), (3, lon)):
        if v:
            place += [(k, 2, 2, v[0].encode() + b"\0"), (k + 1, 5, 3, struct.pack(">6I", v[1], 1, v[2], 1, v[3], 100))]
    first = 8 + len(directory([*own, (0x8769, 4, 1, b"0000"), (0x8825, 4, 1, b"0000")], 8))
    second = first + len(directory(shot, first))
    top = directory([*own, (0x8769, 4, 1, struct.pack(">I", first)), (0x8825, 4, 1, struct.pack(">I", second))], 8)
    return b"\xff\xd8Exif\0\0MM\0*\0\0\0\x08" + top + directory(shot, first) + directory(place, second)


def _exif(L: Library) -> DataFrame:
    """Pictures' EXIF blocks of each photo, read back."""
    import pyarrow as pa

    plain = lambda c: F.coalesce(F.regexp_replace(c, r"[^ -~]", "?"), F.lit(""))
    p = L.photos().select(col("photo_id"), plain("make").alias("make"), plain("model").alias("model"), F.date_format("taken", "yyyy:MM:dd HH:mm:ss").alias("date"), "iso", "lat", "lon")

    def pack(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for i, make, model, date, iso, lat, lon in zip(*(c.to_pylist() for c in b.columns)):
                at = lambda v, names, i=i: None if v is None else (names[v < 0], int(abs(v)), i % 60, i % 3000)
                out.append(_block(make, model, date, iso, at(lat, "NS"), at(lon, "EW")))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.binary())], names=["path", "content"])

    t = N.exif(p.mapInArrow(pack, "path string, content binary"))
    return t.select(col("path").cast("long").alias("photo_id"), F.coalesce("make", F.lit("")).alias("make"), F.coalesce("model", F.lit("")).alias("model"), N.exif_date("date").alias("taken"), "iso", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_DMS = "round(sign({c}) * (floor(abs({c})) + (photo_id % 60) / 60.0::DOUBLE + (photo_id % 3000) / 100.0::DOUBLE / 3600), 6)"
_SGN = lambda c: f"CASE WHEN {c} < 0 THEN -1 ELSE 1 END"
q("SC08", f"SELECT photo_id, trim(coalesce(regexp_replace(make, '[^ -~]', '?', 'g'), '')) AS make, trim(coalesce(regexp_replace(model, '[^ -~]', '?', 'g'), '')) AS model, date_trunc('second', taken) AS taken, iso, {_DMS.replace('sign({c})', _SGN('lat')).format(c='lat')} AS lat, {_DMS.replace('sign({c})', _SGN('lon')).format(c='lon')} AS lon FROM ph", _exif)


def _videos(L: Library) -> DataFrame:
    """Movies with their time in a header at the start or behind 200 KB of pictures, in a header of 64 bits, or written out; read back."""
    p = L.photos().where("mtime > 0 and mtime < 2000000000")
    b = lambda t: F.encode(F.lit(t), "utf-8")
    since = col("mtime") + 2_082_844_800
    short = F.concat(b("ftypmoov...lmvhd"), _be4(F.lit(0).cast("long")), _be4(since), _be4(F.lit(0).cast("long")))
    long = F.concat(b("ftypmoov...lmvhd"), F.unhex(F.lit("01000000")), F.unhex(F.lpad(F.hex(since), 16, "0")), F.unhex(F.lit("0000000000000000")))
    far = F.concat(b("ftyp"), F.encode(F.repeat(F.lit("x"), 200_000), "utf-8"), short)
    text = F.concat(b("ftyp com.apple.quicktime.creationdate "), F.encode(F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd'T'HH:mm:ss"), "utf-8"), b("+0000"), short)
    k = col("photo_id") % 20
    head = F.when(k == 0, far).when(k % 3 == 1, long).when(k % 3 == 2, text).otherwise(short)
    return N.video_dates(p.select(col("photo_id").cast("string").alias("path"), head.alias("content"))).select(col("path").cast("long").alias("photo_id"), "taken")


q("SC12", "SELECT photo_id, make_timestamp(mtime * 1000000) AS taken FROM ph WHERE mtime > 0 AND mtime < 2000000000", _videos)


def _tsv(L: Library) -> DataFrame:
    base = fresh(L.spark, "places")
    c = L.cities().where("name is not null")
    cols = [col("id"), col("name"), col("ascii_name"), F.lit(""), col("latitude"), col("longitude"), F.lit("P"), col("feature_code"), col("country_code"), *[F.lit("")] * 5, col("population"), F.lit(""), F.lit(""), col("timezone"), F.lit("")]
    text = F.concat_ws("\t", *[F.coalesce(x.cast("string"), F.lit("")) for x in cols])
    c.select(text.alias("value")).write.text(f"{base}/cities")
    n = c.select(F.concat_ws("\t", "country_code", F.lit("x"), F.lit("x"), F.lit("x"), "country_name").alias("value")).where("country_name is not null").distinct()
    n.write.text(f"{base}/countries")
    return N.tsv_cities(L.spark, f"{base}/cities", f"{base}/countries", 100_000).select("id", "ascii_name", "country_name", "population", "latitude")


q("SC14", "SELECT id, ascii_name, coalesce(country_name, country_code) AS country_name, population, latitude FROM cities WHERE population >= 100000", _tsv)


def _zips(L: Library) -> DataFrame:
    """An archive per document, with the text as a medium in its album's folder and a sidecar, and what its directory says."""
    import io
    import zipfile

    import pyarrow as pa

    def pack(batches):  # noqa: ANN001, ANN202
        for b in batches:
            out = []
            for i, t, album in zip(*(c.to_pylist() for c in b.columns)):
                f = io.BytesIO()
                folder = f"Takeout/Google Photos/{album or 'Photos from 2019'}"
                with zipfile.ZipFile(f, "w") as z:
                    z.writestr(f"{folder}/{i}.jpg", t)
                    z.writestr(f"{folder}/{i}.jpg.json", "{}")
                out.append(f.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    d = L.table("documents").where("text is not null").select(col("doc_id").cast("string").alias("path"), "text", "album_name").dropDuplicates(["path"])
    return N.zip_inventory(d.mapInArrow(pack, "path string, content binary"))


_DOC = "doc AS (SELECT doc_id, any_value(text) AS text, any_value(album_name) AS album FROM documents WHERE text IS NOT NULL GROUP BY doc_id)"
q("SC16", "SELECT doc_id, octet_length(encode(text)) AS size, false AS is_sidecar, album FROM doc UNION ALL SELECT doc_id, 2, true, album FROM doc", lambda L: _zips(L).select(col("archive").cast("long").alias("doc_id"), "size", "is_sidecar", N.folder_of("name").alias("album")), _DOC)
q("SC16_estimate", "SELECT count(*) AS media, count(*) AS sidecars, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) - count(DISTINCT text) AS repeats, count(DISTINCT album) AS albums FROM doc", lambda L: N.import_estimate(_zips(L)), _DOC)


def _published(L: Library) -> DataFrame:
    """Two versions of the library's photos; readers see the last."""
    folder = fresh(L.spark, "versions")
    p = L.photos().select("photo_id", "trashed")
    M.publish(p, folder)
    M.publish(p.where("not trashed"), folder)
    return M.current(L.spark, folder).select("photo_id")


q("SC20", "SELECT photo_id FROM live", _published)
