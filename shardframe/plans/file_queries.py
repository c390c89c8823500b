"""Readers and writers: each query writes files made from the tables to the shared folder and reads them back."""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shardframe.operators import index, sharding, structure
from shardframe.operators.ordinal import running
from shardframe.plans.index_queries import IDX, document_index
from shardframe.plans.registry import query, table
from shardframe.plans.run_queries import marker_logs
from shardframe.plans.sharding_queries import DP, GBS, JOBS, MIN_SAMPLES, PROGRESS, SEED, SHARDS, jobs
from shardframe.session import cut_lineage, new_shared_path, store
from shardframe.sources import checksums, files, index_files, logs, npz, records, shards, state, structures


# Regions of a record file that are read by a task each, where a query shows them at work.
SMALL_REGION = 1 << 16
# Bytes of text to a file of npz samples, which hold it several times as numbers.
PACKED_BYTES = 8 << 20

#: Folders that the files of jobs lie in.
JOB_FOLDERS = 512


def write_texts(df):
    """Write ``(path, ord, data)`` rows as files, a row after the other; returns the file count."""

    def write(batches):
        current, out, done = None, None, 0
        for batch in files.small_batches(batches):
            for path, data in zip(batch["path"].to_pylist(), batch["data"].to_pylist()):
                if path != current:
                    if out is not None:
                        out.close()
                    current, out, done = path, files.AsideFile(path), done + 1
                out.write(data)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    rows = df.select("path", "ord", F.col("data").cast("binary").alias("data"))
    placed = rows.repartition(files.io_parts(df.sparkSession), "path").sortWithinPartitions("path", "ord")
    return placed.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0]


@query("s1_read_index", IDX + 'SELECT file_ord, path, range_ord, "begin", "end" FROM idx')
def s1(spark, sf):
    out = new_shared_path(spark, "index")
    index_files.write_index(document_index(spark, sf), out)
    return index_files.read_index(spark, out)[0]


@query(
    "s2_write_index",
    IDX
    + """, lines AS (SELECT -1 AS f, -1 AS r, count(DISTINCT file_ord)::VARCHAR AS text FROM idx
      UNION ALL SELECT file_ord, -1, path || ' ' || count(*) FROM idx GROUP BY file_ord, path
      UNION ALL SELECT file_ord, range_ord, "begin" || ' ' || "end" FROM idx)
    SELECT row_number() OVER (ORDER BY f, r) - 1 AS line, text FROM lines""",
)
def s2(spark, sf):
    out = new_shared_path(spark, "index")
    index_files.write_index(document_index(spark, sf), out)
    return index_files._global_lines(files.read_lines(spark, out))


@query("s3_read_offsets", IDX + 'SELECT "begin", "end" FROM idx')
def s3(spark, sf):
    out = new_shared_path(spark, "offsets")
    document_index(spark, sf).select(F.concat_ws(" ", "begin", "end").alias("value")).write.text(out)
    return index_files.read_offsets(spark, out).select("begin", "end")


@query(
    "s3_offsets_to_ranges",
    IDX + """, n AS (SELECT *, lead("begin") OVER (PARTITION BY path ORDER BY range_ord) AS nxt FROM idx)
    SELECT path, range_ord AS ord, "begin", nxt AS "end" FROM n WHERE nxt IS NOT NULL""",
)
def s3_ranges(spark, sf):
    idx = cut_lineage(document_index(spark, sf))
    return index_files.offsets_to_ranges(idx.select("path", F.col("range_ord").alias("ord"), F.col("begin").alias("offset")))


def document_records(spark, sf):
    """Record files of ``doc_id:text`` payloads; the folder and their index."""
    out = new_shared_path(spark, "records")
    docs = table(spark, sf, "documents").select(F.concat_ws(":", "doc_id", "text").alias("p"))
    records.write_records(docs.repartition(files.file_count(docs, "p", 8)), "p", out)
    return out, records.build_record_index(spark, out)


@query(
    "s4_build_record_index",
    "SELECT strlen(doc_id || ':' || text)::BIGINT + 16 AS size, count(*) AS n FROM documents GROUP BY 1",
)
def s4(spark, sf):
    _, (good, _) = document_records(spark, sf)
    return good.groupBy((F.col("end") - F.col("begin")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("s5_write_records", "SELECT count(*) AS n, sum(strlen(doc_id || ':' || text) + 16)::BIGINT AS bytes FROM documents")
def s5(spark, sf):
    out, (good, _) = document_records(spark, sf)
    listed = files.list_files(spark, out).agg(F.sum("size")).scalar()
    return good.agg(F.count(F.lit(1)).alias("n")).withColumn("bytes", listed)


@query("s5_append_records", "SELECT doc_id % 3 AS part, count(*) AS n, sum(strlen(doc_id || ':' || text) + 16)::BIGINT AS bytes FROM documents GROUP BY 1")
def s5_append(spark, sf):
    """Three appends to one folder; all of them are read back."""
    out = new_shared_path(spark, "appended")
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws(":", "doc_id", "text").alias("p"))
    count = files.file_count(docs, "p", 4)
    for part in range(3):
        records.write_records(docs.filter(F.col("doc_id") % 3 == part).repartition(count), "p", out)
    good, _ = records.build_record_index(spark, out)
    payload = F.decode(records.record_payload("payload"), "utf-8")
    found = files.read_ranges(good).select((F.regexp_extract(payload, "^([0-9]+):", 1).cast("bigint") % 3).alias("part"), (F.col("end") - F.col("begin")).alias("size"))
    return found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


# Files of 20 records, of which the eighth is damaged: its payload, its length, or the file ends in it.
@query(
    "s4_record_violations",
    """WITH r AS (SELECT doc_id // 20 AS f, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY doc_id // 20) AS n FROM documents)
    SELECT 'f' || f AS file, CASE WHEN n < 8 THEN n WHEN f % 4 = 0 THEN n WHEN f % 4 = 1 THEN n - 1 ELSE 7 END AS good,
      CASE WHEN n < 8 OR f % 4 = 0 THEN NULL WHEN f % 4 = 1 THEN 'bad payload checksum' WHEN f % 4 = 2 THEN 'bad length checksum' ELSE 'truncated' END AS reason
    FROM r GROUP BY f, n""",
)
def s4_violations(spark, sf):
    out = new_shared_path(spark, "damaged")
    docs = table(spark, sf, "documents").select(F.expr("doc_id div 20").alias("f"), "doc_id", F.encode("text", "utf-8").alias("p"))
    placed = running(docs, ["doc_id"], ["f"], position="k")

    def encode(batches):
        for batch in files.small_batches(batches):
            made = list(records.encode_records(batch["p"].to_pylist()))
            for i, (f, k) in enumerate(zip(batch["f"].to_pylist(), batch["k"].to_pylist())):
                if f % 4 and k == 7:
                    body = bytearray(made[i])
                    if f % 4 < 3:
                        body[-1 if f % 4 == 1 else 9] ^= 1
                    made[i] = bytes(body[:-3] if f % 4 == 3 else body)
                elif f % 4 == 3 and k > 7:
                    made[i] = b""
            yield pa.RecordBatch.from_arrays([batch["f"], batch["k"], pa.array(made, pa.binary())], names=["f", "ord", "data"])

    made = placed.select("f", "k", "p").mapInArrow(encode, "f bigint, ord bigint, data binary")
    write_texts(made.select(F.format_string(f"{out}/f%d.rec", "f").alias("path"), "ord", "data"))
    good, bad = records.build_record_index(spark, out)
    name = F.regexp_extract("path", r"/(f\d+)\.rec$", 1).alias("file")
    counts = good.groupBy(name).agg(F.count(F.lit(1)).alias("good"))
    return counts.join(bad.select(name, "reason"), "file", "left")


# Two files, each read by many tasks; the payload of every 25th record holds two whole records.
@query(
    "s4_split_files",
    """SELECT doc_id, (CASE WHEN doc_id % 25 = 0 THEN 2 * (strlen(text) + 16) ELSE strlen(text) END + 16)::BIGINT AS size, doc_id % 25 = 0 AS nested FROM documents""",
)
def s4_split(spark, sf):
    out = new_shared_path(spark, "split")

    def pack(batches):
        for batch in files.small_batches(batches):
            made = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                body = (text or "").encode()
                made.append(struct.pack(">q", doc) + (b"".join(records.encode_records([body, body])) if doc % 25 == 0 else body))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["p"])

    docs = table(spark, sf, "documents").select("doc_id", "text")
    records.write_records(docs.mapInArrow(pack, "p binary").repartition(files.file_count(docs, "text", 2)), "p", out)
    good, bad = records.build_record_index(spark, out, region=SMALL_REGION)
    number = F.conv(F.hex(F.substring(records.record_payload("payload"), 1, 8)), 16, 10).cast("bigint")
    found = files.read_ranges(good).select(number.alias("doc_id"), (F.col("end") - F.col("begin") - 8).alias("size"))
    lost = bad.select(F.lit(None).cast("bigint").alias("doc_id"), (F.col("end") - F.col("begin")).alias("size"))
    return found.unionByName(lost).withColumn("nested", F.col("doc_id") % 25 == 0)


@query("s6_read_ranges", "SELECT doc_id, md5(text) AS md5 FROM documents")
def s6(spark, sf):
    _, (good, _) = document_records(spark, sf)
    payload = F.decode(records.record_payload("payload"), "utf-8")
    read = files.read_ranges(good).select(payload.alias("p"))
    return read.select(
        F.regexp_extract("p", "^([0-9]+):", 1).cast("bigint").alias("doc_id"), F.md5(F.regexp_replace("p", "^[0-9]+:", "")).alias("md5")
    )


@query(
    "s7_read_npz_samples",
    """SELECT conv_id, turn, length(text)::BIGINT AS tokens, list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)))::BIGINT AS total
    FROM conversations""",
)
def s7(spark, sf):
    def pack(batches):
        for batch in files.small_batches(batches):
            rows = []
            for conv, turn, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "text"))):
                buffer = io.BytesIO()
                np.savez(buffer, text=np.array([conv, turn, *map(ord, text)], np.int32))
                rows.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["p"])

    out = new_shared_path(spark, "npz")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    records.write_records(turns.mapInArrow(pack, "p binary").repartition(files.file_count(turns, "text", 4, PACKED_BYTES)), "p", out)
    good, _ = records.build_record_index(spark, out)
    inner = good.select("path", (F.col("begin") + records.HEAD).alias("begin"), (F.col("end") - records.TAIL).alias("end"))
    samples = npz.read_npz_samples(inner, "gpt")
    codes = F.slice("text", F.lit(3), F.size("text"))
    return samples.select(
        F.col("text")[0].alias("conv_id"), F.col("text")[1].alias("turn"), F.size(codes).cast("bigint").alias("tokens"),
        F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: a + c).alias("total"),
    )


# A masked sample per turn: codes, two kinds of marks, and flags.
@query(
    "s7_read_bert_samples",
    """SELECT conv_id, turn, length(text)::BIGINT AS tokens, list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)))::BIGINT AS total,
      length(text)::BIGINT * turn AS types, (conv_id % 2)::INTEGER AS is_random, (CASE WHEN length(text) > 100 THEN 1 ELSE 0 END)::INTEGER AS truncated
    FROM conversations""",
)
def s7_bert(spark, sf):
    def pack(batches):
        for batch in files.small_batches(batches):
            rows = []
            for conv, turn, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "text"))):
                codes = np.array([*map(ord, text)], np.int32)
                buffer = io.BytesIO()
                np.savez(
                    buffer, text=np.concatenate([[conv, turn], codes]).astype(np.int32), types=np.full(len(codes), turn), labels=codes, loss_mask=codes * 0,
                    padding_mask=codes * 0 + 1, is_random=np.array(conv % 2), truncated=np.array(int(len(codes) > 100)),
                )
                rows.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["p"])

    out = new_shared_path(spark, "bert")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    records.write_records(turns.mapInArrow(pack, "p binary").repartition(files.file_count(turns, "text", 4, PACKED_BYTES)), "p", out)
    good, _ = records.build_record_index(spark, out)
    inner = good.select("path", (F.col("begin") + records.HEAD).alias("begin"), (F.col("end") - records.TAIL).alias("end"))
    samples = npz.read_npz_samples(inner, "bert")
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return samples.select(
        F.col("text")[0].alias("conv_id"), F.col("text")[1].alias("turn"), add("padding_mask").alias("tokens"), add("labels").alias("total"),
        add("types").alias("types"), "is_random", "truncated",
    )


@query(
    "s8_write_shards",
    SHARDS.replace("n_chars + 16 AS length", "strlen(doc_id || ':' || text) + 16 AS length")
    + "SELECT dp_rank, file_id, count(*) AS n_samples, sum(length)::BIGINT AS bytes FROM files GROUP BY 1, 2",
)
def s8(spark, sf):
    _, (good, _) = document_records(spark, sf)
    payload = F.decode(records.record_payload("payload"), "utf-8")
    ranges = cut_lineage(
        files.read_ranges(good).select(
            F.regexp_extract(payload, "^([0-9]+):", 1).cast("bigint").alias("sample_id"), "path", "begin", "end"
        )
    )
    assigned = sharding.assign_shards(ranges, "sample_id", GBS, DP, PROGRESS, SEED)
    packed = sharding.pack_shard_files(assigned, GBS, DP, MIN_SAMPLES)
    local = sharding.shard_index(packed, ranges.select("sample_id", (F.col("end") - F.col("begin")).alias("length")))
    written = cut_lineage(shards.write_shards(ranges, local, new_shared_path(spark, "shards")))
    # What was written is read back: the records of every shard file must be whole.
    folder = written.select(F.regexp_extract("path", r"^(.*)/rank-\d+/[^/]+$", 1)).first()[0]
    found, _ = records.build_record_index(spark, f"{folder}/*/*.tf_record")
    name = r"rank-(\d+)/(\d+)\.tf_record$"
    return found.groupBy(
        F.regexp_extract("path", name, 1).cast("bigint").alias("dp_rank"), F.regexp_extract("path", name, 2).cast("bigint").alias("file_id")
    ).agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.col("end") - F.col("begin")).alias("bytes"))


def written_shards(spark, sf):
    """The shard files of the documents as written, their local index, and the assignment."""
    _, (good, _) = document_records(spark, sf)
    payload = F.decode(records.record_payload("payload"), "utf-8")
    ranges = cut_lineage(
        files.read_ranges(good).select(F.regexp_extract(payload, "^([0-9]+):", 1).cast("bigint").alias("sample_id"), "path", "begin", "end")
    )
    assigned = sharding.assign_shards(ranges, "sample_id", GBS, DP, PROGRESS, SEED, job="docs")
    packed = sharding.pack_shard_files(assigned, GBS, DP, MIN_SAMPLES)
    local = sharding.shard_index(packed, ranges.select("sample_id", (F.col("end") - F.col("begin")).alias("length")))
    return cut_lineage(shards.write_shards(ranges, local, new_shared_path(spark, "shards"))), packed


WRITTEN = SHARDS.replace("n_chars + 16 AS length", "strlen(doc_id || ':' || text) + 16 AS length")


# Every written index file is read as an index, the sample ids beside it as lines.
@query(
    "s8_shard_index_files",
    WRITTEN
    + """SELECT dp_rank, file_id, row_number() OVER w - 1 AS ord, sample_id,
      (sum(length) OVER w - length)::BIGINT AS "begin", (sum(length) OVER w)::BIGINT AS "end"
    FROM files WINDOW w AS (PARTITION BY dp_rank, file_id ORDER BY batch, pos_in_rank)""",
)
def s8_index(spark, sf):
    written, _ = written_shards(spark, sf)
    folder = written.select(F.regexp_extract("path", r"^(.*)/rank-\d+/[^/]+$", 1).alias("d")).agg(F.min("d")).first()[0]
    rank, file_id = (F.regexp_extract("path", r"rank-(\d+)/(\d+)\.tf_record", i).cast("bigint") for i in (1, 2))
    # After the two lines of the header a line is a range.
    lines = files.read_lines(spark, f"{folder}/*/*.idx").filter("line_no >= 2").select(
        rank.alias("dp_rank"), file_id.alias("file_id"), (F.col("line_no") - 2).alias("ord"),
        F.split("text", " ")[0].cast("bigint").alias("begin"), F.split("text", " ")[1].cast("bigint").alias("end"),
    )
    ids = files.read_lines(spark, f"{folder}/*/*.meta").select(
        rank.alias("dp_rank"), file_id.alias("file_id"), F.col("line_no").alias("ord"), F.col("text").cast("bigint").alias("sample_id")
    )
    return lines.join(ids, ["dp_rank", "file_id", "ord"])


# What the manifests tell against the records of the files written.
@query(
    "d13_written_shards",
    WRITTEN
    + f"""SELECT dp_rank, count(*) AS n_read, (((SELECT count(*) FROM documents) - {PROGRESS}) // {GBS}) * CASE WHEN dp_rank = 3 THEN 5 ELSE 6 END AS n_expected,
      true AS ok FROM shards GROUP BY dp_rank""",
)
def d13_written(spark, sf):
    written, packed = written_shards(spark, sf)
    folder = written.select(F.regexp_extract("path", r"^(.*)/rank-\d+/[^/]+$", 1).alias("d")).agg(F.min("d")).first()[0]
    found, _ = records.build_record_index(spark, f"{folder}/*/*.tf_record")
    read = found.select(F.regexp_extract("path", r"rank-(\d+)/", 1).cast("bigint").alias("dp_rank"))
    told = sharding.manifests(packed, GBS).filter(F.col("path").endswith("/batch-sizes.txt"))
    parsed = sharding.parse_runs(told.select(F.regexp_extract("path", r"rank-(\d+)/", 1).cast("bigint").alias("dp_rank"), F.concat("line", F.lit("\n")).alias("text")), "text")
    return sharding.verify_shards(read, parsed)


# A job per customer with orders: its points and degrees as JSON files, in steps or, for odd customers, in times whose steps are observed.
@query(
    "d15_json_jobs",
    JOBS
    + """SELECT 'job' || job AS job, stage, step AS start_step, end_step, step * 32 AS progress, size, mp::BIGINT AS mp, pp::BIGINT AS pp, dp AS dp_size
    FROM nxt JOIN conf USING (job, size) WHERE size = mp * dp * pp""",
)
def d15_json(spark, sf):
    out = new_shared_path(spark, "jobs")
    points, configs = jobs(spark, sf)
    job = F.concat(F.lit("job"), F.col("job").cast("string"))
    # Tasks that make files in one folder wait for each other, and one task lists it.
    spread = F.pmod(F.xxhash64("job"), F.lit(JOB_FOLDERS)).cast("string")
    name = lambda folder: F.concat(F.lit(f"{out}/{folder}/"), spread, F.lit("/"), job, F.lit(".json")).alias("path")
    # A file holds one job's points; they are texts, joined in the order of their steps.
    text = F.when(F.col("job") % 2 == 0, F.format_string('{"step": %d, "size": %d}', "step", "size")).otherwise(
        F.format_string('{"time": %d, "size": %d}', F.col("step") * 10, "size")
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("step", text.alias("text")))), lambda x: x["text"])
    schedules = points.groupBy("job").agg(lines.alias("lines")).select(
        name("schedules"), F.lit(0).alias("ord"), F.concat(F.lit("["), F.array_join("lines", ", "), F.lit("]")).alias("data")
    )
    degrees = F.format_string('"%d": {"dp_size": %d, "pp_size": %d, "mp_size": %d}', "size", "dp", "pp", "mp")
    written = configs.join(points.select("job").distinct(), "job").groupBy("job").agg(F.array_sort(F.collect_list(degrees)).alias("lines")).select(
        name("degrees"), F.lit(0).alias("ord"), F.concat(F.lit("{"), F.array_join("lines", ", "), F.lit("}")).alias("data")
    )
    write_texts(schedules.unionByName(written))
    observed = points.filter("job % 2 = 1").select(job.alias("job"), (F.col("step") * 10).alias("time"), "step")
    # The files are read once, however often the plan looks at the points.
    told = store(structures.read_schedule(spark, f"{out}/schedules").drop("point"), "points")
    return sharding.stage_plan(told, structures.read_para_configs(spark, f"{out}/degrees"), 32, observed, last_step=100000000)[0]


def state_tree(spark, sf):
    """A state directory: snapshot per region, rank per supplier, with one tensor, two values and a list."""
    from shardframe.operators.tensors import encode_elements, format_meta

    out = new_shared_path(spark, "state")
    suppliers = table(spark, sf, "supplier")
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    joined = suppliers.join(vectors, F.col("s_suppkey") == F.col("vec_id"), "left")
    joined = joined.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.5).cast("float"), 64)))
    root = F.format_string(f"{out}/n%d/%d/", "s_nationkey", "s_suppkey")
    shape = F.expr("array(4L, 16L)")
    rows = [
        ("model/weight.numpy.ndarray", encode_elements(F.col("embedding"), "f32")),
        ("model/weight.numpy.ndarray.meta", F.encode(format_meta(F.lit("f32"), shape), "utf-8")),
        ("iteration.int", F.encode(F.col("s_suppkey").cast("string"), "utf-8")),
        ("args/name.str", F.encode("s_name", "utf-8")),
        ("groups/dir.meta", F.encode(F.lit("list\n2"), "utf-8")),
    ]
    entries = F.explode(F.array(*[F.struct(F.concat(root, F.lit(name)).alias("path"), data.alias("data")) for name, data in rows]))
    write_texts(joined.select(entries.alias("e")).select("e.path", F.lit(0).alias("ord"), "e.data"))
    return state.read_state_dir(spark, out, chunk_bytes=128)


STATE = """WITH s AS (SELECT 'n' || s_nationkey AS snapshot, s_suppkey AS rank, s_name, coalesce(embedding, list_transform(range(64), lambda i: 0.5::FLOAT)) AS e
  FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey)
"""


@query(
    "s9_read_state_dir",
    STATE
    + """SELECT snapshot, rank, 'model/weight' AS path, 'f32' AS dtype, (4 * c.c // 2)::BIGINT AS place, round(list_sum(list_transform(e[c.c * 32 + 1:c.c * 32 + 32], lambda x: x::DOUBLE)), 6)::VARCHAR AS value
      FROM s, (VALUES (0), (1)) c(c)
    UNION ALL SELECT snapshot, rank, 'iteration', 'int', 0, rank::VARCHAR FROM s
    UNION ALL SELECT snapshot, rank, 'args/name', 'str', 0, s_name FROM s
    UNION ALL SELECT snapshot, rank, 'groups', 'list', 2, NULL FROM s""".replace("round(list_sum", "printf('%.4f', list_sum").replace(", 6)::VARCHAR AS value", ") AS value"),
)
def s9(spark, sf):
    from shardframe.operators.tensors import decode_array

    tensors, values, lists, _ = state_tree(spark, sf)
    total = F.aggregate(decode_array("f32"), F.lit(0.0), lambda a, x: a + x)
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    a = tensors.select("snapshot", "rank", "path", "dtype", F.col("chunk_offset")[0].alias("place"), F.format_string("%.4f", total).alias("value"))
    b = values.select("snapshot", "rank", "path", "dtype", zero.alias("place"), "value")
    c = lists.select("snapshot", "rank", "path", F.lit("list").alias("dtype"), F.col("length").alias("place"), none.alias("value"))
    return a.unionByName(b).unionByName(c)


@query(
    "s10_save_state",
    """SELECT 'n' || s_nationkey AS snapshot, s_suppkey AS rank, 'step' AS path, 'int' AS dtype,
      (CASE WHEN s_nationkey = 3 THEN 2 ELSE 1 END)::VARCHAR AS value FROM supplier""",
)
def s10(spark, sf):
    out = new_shared_path(spark, "saved")

    def tables(step, where):
        rows = table(spark, sf, "supplier").filter(where).select(
            F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("snapshot"), F.col("s_suppkey").alias("rank"), F.lit("step").alias("path")
        )
        tensors = rows.select(
            "*", F.lit("u8").alias("dtype"), F.expr("array(1L)").alias("shape"), F.expr("array(0L)").alias("chunk_offset"),
            F.expr("array(1L)").alias("chunk_shape"), F.lit(b"\x01").alias("data"),
        )
        values = rows.select("*", F.lit("int").alias("dtype"), F.lit(str(step)).alias("value"))
        return tensors, values, rows.select("*", F.lit(0).cast("bigint").alias("length"))

    state.save_state(*tables(1, "true"), out)
    # Saving some ranks again replaces theirs only.
    state.save_state(*tables(2, "s_nationkey = 3"), out)
    return state.load_state(spark, out)[1]


# Beside the good files of every rank: a tensor without meta, one of a wrong size, an unknown type, an endless list.
@query(
    "s9_state_violations",
    """SELECT 'n' || s_nationkey || '/' || s_suppkey || '/' || v.name AS name, v.reason FROM supplier, (VALUES
      ('bare.numpy.ndarray', 'tensor without a meta file'), ('short.numpy.ndarray', 'size does not fit the shape'),
      ('x.pickle', 'unknown type'), ('bad/dir.meta', 'list without a length')) v(name, reason)""",
)
def s9_violations(spark, sf):
    out = new_shared_path(spark, "bad-state")
    root = F.format_string(f"{out}/n%d/%d/", "s_nationkey", "s_suppkey")
    rows = [
        ("good.int", b"1"), ("bare.numpy.ndarray", b"1234"), ("short.numpy.ndarray", b"1234"), ("short.numpy.ndarray.meta", b"f32\n1\n3\n"),
        ("x.pickle", b"x"), ("bad/dir.meta", b"list"), ("empty.numpy.ndarray", b""), ("empty.numpy.ndarray.meta", b"f32\n1\n0\n"),
    ]
    entries = F.explode(F.array(*[F.struct(F.concat(root, F.lit(name)).alias("path"), F.lit(data).alias("data")) for name, data in rows]))
    write_texts(table(spark, sf, "supplier").select(entries.alias("e")).select("e.path", F.lit(0).alias("ord"), "e.data"))
    bad = state.read_state_dir(spark, out)[3]
    return bad.select(F.regexp_extract("file", r"/(n\d+/\d+/.+)$", 1).alias("name"), "reason")


@query(
    "s13_read_structures",
    """SELECT 'pp02/mp' || lpad((1 + s_nationkey % 4)::VARCHAR, 2, '0') || '/dp01' AS config_id, s_suppkey AS rank, 'model/w' AS path, (s_suppkey + 1)::BIGINT AS rows FROM supplier""",
)
def s13(spark, sf):
    out = new_shared_path(spark, "structures")
    config = F.format_string("pp02/mp%02d/dp01", F.col("s_nationkey") % 4 + 1)
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit(f"{out}/"), config, F.format_string("/rank%02d/mp_rank_00_001.json", "s_suppkey")).alias("path"),
        F.lit(0).alias("ord"),
        F.format_string('{"model": {"w": {"tensor": [%d, 2]}}}', F.col("s_suppkey") + 1).alias("data"),
    )
    write_texts(rows)
    tensors, _ = structure.state_leaves(structures.read_structures(spark, out))
    return tensors.select("config_id", "rank", "path", F.col("shape")[0].alias("rows"))


@query(
    "s13_rank_map_and_keys",
    """SELECT 'pp02/mp02/dp' || lpad(s_suppkey::VARCHAR, 4, '0') AS config_id, r.r AS rank, r.r // 2 AS pp, r.r % 2 AS mp, 'model/b/a' AS first_key
    FROM supplier, (SELECT unnest(range(4)) AS r) r""",
)
def s13_maps(spark, sf):
    out = new_shared_path(spark, "maps")
    ranks = ", ".join(f'"{r}": {{"pp_rank": {r // 2}, "mp_rank": {r % 2}, "dp_rank": 0}}' for r in range(4))
    keys = ", ".join(f'"{r}": [["model", "b", "a"], ["model", "a"]]' for r in range(4))
    folder = F.format_string(f"{out}/pp02/mp02/dp%04d", "s_suppkey")
    entries = F.array(
        F.struct(F.concat(folder, F.lit("/rank_map.json")).alias("path"), F.lit(f"{{{ranks}}}").alias("data")),
        F.struct(F.concat(folder, F.lit("/model_keys.json")).alias("path"), F.lit(f"{{{keys}}}").alias("data")),
    )
    write_texts(table(spark, sf, "supplier").select(F.explode(entries).alias("e")).select("e.path", F.lit(0).alias("ord"), "e.data"))
    first = structures.read_model_keys(spark, out).filter("key_ord = 0").select("config_id", "rank", F.col("path").alias("first_key"))
    return structures.read_rank_map(spark, out).join(first, ["config_id", "rank"]).drop("dp")


def log_files(spark, sf):
    """The marker logs as one file per user in a folder per user group."""
    out = new_shared_path(spark, "logs")
    rows = marker_logs(spark, sf).select(
        F.concat(F.lit(f"{out}/g"), F.substring("file", -1, 1), F.lit("/"), "file", F.lit(".log")).alias("path"),
        F.col("line_no").alias("ord"), F.concat("text", F.lit("\n")).alias("data"),
    )
    write_texts(rows)
    return out


LOG_LINES = """WITH t AS (SELECT *, CASE event_type WHEN 'signup' THEN printf('Finished pretrain %.2f', value) WHEN 'view' THEN printf('Start pretrain %.2f', value)
    WHEN 'click' THEN printf('State transformation took %.2fs', value) WHEN 'purchase' THEN 'Step: ' || event_id || ',' || chr(9) || printf('Loss: %.2f', value)
    ELSE 'retry Step: ' || event_id || ',' || chr(9) || printf('Loss: %.2f', value) END AS text FROM events)
"""


@query(
    "s14_read_logs",
    LOG_LINES + """SELECT 'g' || right(user_id::VARCHAR, 1) AS run_id, 'g' || right(user_id::VARCHAR, 1) || '/u' || user_id || '.log' AS file,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no, text FROM t""",
)
def s14(spark, sf):
    # Blocks of a few pages, so that large logs span several.
    return logs.read_logs(spark, log_files(spark, sf), block=1 << 14)


@query(
    "s15_write_metrics",
    "SELECT event_type AS run_id, event_id AS step, value FROM events",
)
def s15(spark, sf):
    out = new_shared_path(spark, "metrics")
    metrics = table(spark, sf, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").alias("step"), "value")
    logs.write_metrics(metrics, out)
    return logs.read_metrics(spark, out, "run_id string, step bigint, value double")


@query(
    "i10_verify_md5",
    LOG_LINES + """, m AS (SELECT user_id, md5(string_agg(text || chr(10), '' ORDER BY event_id)) AS md5 FROM t GROUP BY user_id),
    e AS (SELECT user_id, CASE WHEN user_id % 7 = 1 THEN md5('x') ELSE md5 END AS md5 FROM m WHERE user_id % 7 <> 0)
    SELECT 'u' || user_id AS file, m.md5 AS actual, e.md5 AS expected, CASE WHEN e.md5 IS NULL THEN 'unexpected' WHEN m.md5 = e.md5 THEN 'ok' ELSE 'mismatch' END AS status
      FROM m LEFT JOIN e USING (user_id)
    UNION ALL SELECT 'c' || c_custkey, NULL, md5('x'), 'missing' FROM customer WHERE c_custkey % 50 = 0""",
)
def i10(spark, sf):
    name = F.regexp_extract("path", r"([^/]+)\.log$", 1)
    manifest = cut_lineage(checksums.md5_manifest(spark, log_files(spark, sf)).withColumn("path", name))
    user = F.substring("path", 2, 20).cast("bigint")
    expected = manifest.filter(user % 7 != 0).withColumn("md5", F.when(user % 7 == 1, F.md5(F.lit("x"))).otherwise(F.col("md5")))
    absent = table(spark, sf, "customer").filter("c_custkey % 50 = 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.md5(F.lit("x")).alias("md5")
    )
    return index.verify_md5(manifest, expected.unionByName(absent)).withColumnRenamed("path", "file")
