"""Registered queries on archives, packets, volumes, evidence nodes, exact numbers and channel relations."""

from pyspark.sql import functions as F

from bioquery.functions import scalar
from bioquery.operators import archives, kernels, records, signal
from bioquery.plans import catalogue
from bioquery.plans.catalogue import S, _s, _t, _w, query

_TREE = "source || '/' || lang || '/' || doc_id || '.txt'"


def _files(spark, sf):
    """Documents as files by source and language."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return _t(spark, sf, "documents").select("doc_id", path.alias("path"), F.col("text").cast("binary").alias("content"))


@query("""SELECT doc_id, octet_length(encode(text)) AS original_size, CASE WHEN octet_length(encode(text)) < 400 THEN 'any' WHEN doc_id % 3 = 0 THEN 'store' ELSE 'zstd' END AS method, CASE WHEN octet_length(encode(text)) >= 400 THEN doc_id % 3 <> 0 END AS smaller,
  sha256(text) AS sha256, true AS ok FROM documents""")
def archive_pack_extract(spark, sf):
    """Packed and extracted again: the digest is of what comes out; methods and savings of files that are long enough to be packed."""
    docs = _t(spark, sf, "documents")
    path = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".gz").otherwise(".txt"))
    entries = archives.pack(docs.select(path.alias("path"), F.col("text").cast("binary").alias("content")))
    out = entries.join(archives.extract(entries), "path")
    long = F.col("original_size") >= 400
    return out.select(F.regexp_extract("path", "^[0-9]+", 0).cast("long").alias("doc_id"), "original_size", F.when(long, F.col("method")).otherwise("any").alias("method"), F.when(long, F.col("stored_size") < F.col("original_size")).alias("smaller"), F.sha2("content", 256).alias("sha256"), "ok")


@query(f"""WITH f AS (SELECT source, lang, octet_length(encode(text)) AS n FROM documents)
  SELECT coalesce(CASE WHEN lang IS NULL THEN source ELSE source || '/' || lang END, '') AS dir, count(*) AS n_files, sum(n)::BIGINT AS original FROM f GROUP BY ROLLUP (source, lang)""")
def archive_listing(spark, sf):
    entries = _files(spark, sf).select("path", F.length("content").cast("long").alias("original_size"), F.lit(0).cast("long").alias("stored_size"))
    return archives.listing(entries).select("dir", "n_files", "original")


_NAMES = "CASE doc_id % 4 WHEN 0 THEN p WHEN 1 THEN doc_id || '.txt' WHEN 2 THEN lang || '/' || doc_id || '.txt' ELSE 'none/' || doc_id || '.txt' END"


@query(f"WITH f AS (SELECT doc_id, lang, {_TREE} AS p FROM documents) SELECT {_NAMES} AS name, CASE WHEN doc_id % 4 <> 3 THEN p END AS path FROM f")
def archive_find_entries(spark, sf):
    k, p = F.col("doc_id"), F.col("path")
    name = F.when(k % 4 == 0, p).when(k % 4 == 1, F.element_at(F.split(p, "/"), -1)).when(k % 4 == 2, F.array_join(F.slice(F.split(p, "/"), 2, 2), "/")).otherwise(F.concat(F.lit("none/"), F.element_at(F.split(p, "/"), -1)))
    files = _files(spark, sf)
    return archives.find_entries(files, files.select(name.alias("name")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lower(hex(encode(text)[1:9])) END AS prefix FROM documents".replace("encode(text)[1:9]", "encode(text)").replace("lower(hex(encode(text)))", "substr(lower(hex(encode(text))), 1, 18)"))
def archive_prefixes(spark, sf):
    """The first nine bytes of entries that are stored as they are."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("stored"), F.when(F.col("doc_id") % 3 == 0, "store").otherwise("zstd").alias("method"))
    return archives.prefixes(docs, docs.select(F.col("path").alias("name")), 9).select(F.col("name").cast("long").alias("doc_id"), F.lower(F.hex("prefix")).alias("prefix"))


@query(f"""WITH {catalogue._ENTRIES}, o AS (SELECT *, sum(compressed_size) OVER (PARTITION BY archive ORDER BY path) AS stop FROM e), z AS (SELECT archive, sum(compressed_size) - 40 AS n FROM e GROUP BY archive)
  SELECT archive, path, CASE WHEN stop > n THEN 'OUT OF BOUNDS' WHEN doc_id % 29 = 3 THEN 'UNREADABLE' WHEN doc_id % 31 = 4 THEN 'SHA256 MISMATCH' ELSE 'OK' END AS status FROM o JOIN z USING (archive)""")
def archive_verify_entries(spark, sf):
    """Archives cut short by 40 bytes, with seeded unreadable and changed entries."""
    entries = records.offsets(catalogue._entries(spark, sf)).withColumnRenamed("compressed_size", "stored_size")
    seen = F.when(F.col("doc_id") % 29 == 3, F.lit(None)).when(F.col("doc_id") % 31 == 4, "changed").otherwise(F.col("sha256"))
    sizes = entries.groupBy("archive").agg((F.sum("stored_size") - 40).alias("payload_size"))
    return archives.verify(entries.withColumn("seen_sha256", seen), sizes)


@query("SELECT page_id, ['packet', 'archive', 'container', 'tensor', 'unknown', 'empty'][page_id % 6 + 1] AS kind FROM pages")
def container_dispatch(spark, sf):
    heads = F.array(*map(F.lit, ("LML1", "LMA1", "BCS2", "LQTP1", "LML", "")))
    content = F.when(F.col("page_id") % 6 == 5, "").otherwise(F.concat(F.element_at(heads, (F.col("page_id") % 6 + 1).cast("int")), "url"))
    files = _t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), content.cast("binary").alias("content"))
    return archives.dispatch(files).select(F.col("path").cast("long").alias("page_id"), "kind")


@query("SELECT doc_id AS path, doc_id % 5 <> 1 AND doc_id % 7 <> 2 AND doc_id % 9 <> 4 AS match, CASE WHEN doc_id % 9 = 4 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'header' WHEN doc_id % 7 = 2 THEN 'trailing' END AS first_diff FROM documents")
def roundtrip_slices(spark, sf):
    """Four digests of each file against those of what was recovered, with seeded differences."""
    k, text = F.col("doc_id"), F.col("text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    first = _t(spark, sf, "documents").select(k.alias("path"), sha(text).alias("signal"), sha(F.substring(text, 1, 256)).alias("header"), sha(F.lower(text)).alias("other"), F.when(k % 2 == 0, sha(F.reverse(text))).alias("trailing"))
    changed = first.where("path % 9 <> 4").withColumns({"header": F.when(F.col("path") % 5 == 1, "x").otherwise(F.col("header")), "trailing": F.when(F.col("path") % 7 == 2, "x").otherwise(F.col("trailing"))})
    return archives.compare_slices(first, changed)


@query(f"""WITH {S.replace("s AS (", "signal AS (", 1)}, {catalogue._band_bytes_sql()}, c AS (SELECT ch, sum(n_bytes + 5)::BIGINT AS band_bytes FROM r GROUP BY ch)
  SELECT s.ch AS win, CASE WHEN count(*) >= 32 THEN any_value(band_bytes) + 26 ELSE -1 END AS n_bytes, sum(x * (t + 1))::BIGINT AS checksum, sum(x * (t + 1))::BIGINT AS older, true AS refused FROM s JOIN c USING (ch) GROUP BY s.ch""".replace("+ 26", "+ 22"))
def packet_roundtrip(spark, sf):
    """Packets of every window: bytes without prediction, what they decode to with either checksum, and whether a changed header is refused."""

    def run(pdf):
        import zlib

        import numpy as np
        import pandas as pd

        x = pdf.sort_values("t")["x"].to_numpy()
        total = lambda z: int((z * np.arange(1, len(z) + 1)).sum())
        data = archives.encode_packet(x)
        older = data[:18] + zlib.crc32(data[22:]).to_bytes(4, "little") + data[22:]
        try:
            archives.decode_packet(data[:7] + bytes([data[7] ^ 1]) + data[8:])
            refused = False
        except ValueError:
            refused = True
        plain = len(archives.encode_packet(x, predict=False)) if len(x) >= 32 else -1
        return pd.DataFrame({"win": [f"{pdf['ch'].iloc[0]}:{pdf['win'].iloc[0]}"], "n_bytes": [plain], "checksum": [total(archives.decode_packet(data))], "older": [total(archives.decode_packet(older))], "refused": [refused]})

    return _w(spark, sf, 512).groupBy("ch", "win").applyInPandas(run, "win string, n_bytes long, checksum long, older long, refused boolean")


@query("""SELECT doc_id, unnest(range(1, 1 + (length(text) + 99) // 100)) AS volume, (unnest(range(1, 1 + (length(text) + 99) // 100)) - 1) * 100 AS start,
  least(unnest(range(1, 1 + (length(text) + 99) // 100)) * 100, length(text)) AS "end" FROM documents WHERE length(text) BETWEEN 1 AND 99900""")
def volume_split(spark, sf):
    """Byte ranges of a hundred characters; texts that would take more than 999 volumes are an error, so they are not asked for."""
    files = _t(spark, sf, "documents").where(F.length("text").between(1, 99900)).select(F.col("doc_id").cast("string").alias("path"), F.length("text").cast("long").alias("n_bytes"))
    return archives.volumes(files, 100).select(F.col("path").cast("long").alias("doc_id"), "volume", "start", "end")


@query("""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn, l_partkey AS n FROM lineitem WHERE NOT (l_orderkey % 5 = 2 AND l_linenumber = 2))
  SELECT k::VARCHAR AS path, sum(n)::BIGINT AS n_bytes, min(CASE WHEN v <> rn THEN rn END) AS problem FROM p GROUP BY k""")
def volume_assemble(spark, sf):
    parts = _t(spark, sf, "lineitem").where("not (l_orderkey % 5 = 2 and l_linenumber = 2)")
    return archives.assemble(parts.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("volume"), F.col("l_partkey").alias("n_bytes")))


@query("""WITH i AS (SELECT l_orderkey AS rec, 'p' || l_partkey || '_' || l_linenumber AS path, CASE WHEN l_orderkey % 4 = 1 AND l_linenumber = 1 THEN NULL ELSE l_linenumber - 1 END AS chunk, count(*) OVER (PARTITION BY l_orderkey) + CASE WHEN l_orderkey % 6 = 2 AND l_linenumber = 1 THEN 1 ELSE 0 END AS n FROM lineitem),
  g AS (SELECT rec, count(*) AS files, count(chunk) = count(*) AS marked, min(n) AS low, max(n) AS high, count(DISTINCT chunk) AS kinds, min(chunk) AS first, max(chunk) AS last FROM i GROUP BY rec),
  p AS (SELECT rec, marked, CASE WHEN marked AND low <> high THEN 'chunk counts disagree' WHEN marked AND low <> files THEN 'wrong number of files' WHEN marked AND NOT (kinds = files AND first = 0 AND last = files - 1) THEN 'gap or repeat' END AS problem FROM g)
  SELECT rec, path, CASE WHEN problem IS NULL THEN row_number() OVER (PARTITION BY rec ORDER BY CASE WHEN marked THEN chunk END, path) - 1 END AS place, problem FROM i JOIN p USING (rec)""")
def concat_order(spark, sf):
    rows = _t(spark, sf, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    of = rows.groupBy("l_orderkey").agg(F.count("*").alias("files"))
    chunk = F.when(~((k % 4 == 1) & (n == 1)), n - 1)
    path = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("_"), n.cast("string"))
    inputs = rows.join(of, "l_orderkey").select(k.alias("rec"), path.alias("path"), chunk.alias("chunk"), (F.col("files") + F.when((k % 6 == 2) & (n == 1), 1).otherwise(0)).alias("n_chunks"))
    return archives.concat_order(inputs)


@query("SELECT o_orderkey::VARCHAR AS name, o_custkey AS version, CASE WHEN o_orderkey % 6 = 1 THEN 'MISSING' WHEN o_orderkey % 10 = 3 THEN 'SHA256 MISMATCH' ELSE 'OK' END AS status FROM orders")
def registry_status(spark, sf):
    k = F.col("o_orderkey")
    pins = _t(spark, sf, "orders").select(k.cast("string").alias("name"), F.col("o_custkey").alias("version"), F.sha2(k.cast("string").cast("binary"), 256).alias("sha256"), k)
    files = pins.where("o_orderkey % 6 <> 1").withColumn("sha256", F.when(k % 10 == 3, "x").otherwise(F.col("sha256")))
    return archives.registry_status(pins, files)


@query("SELECT name, version, place FROM (SELECT o_custkey AS name, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 3")
def registry_history(spark, sf):
    """The last three entries of each name: the limit is what is asked for."""
    log = _t(spark, sf, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("at"))
    return archives.history(log, 3).select("name", "version", "place")


_KEY = b"key of the archive"
_IPAD, _OPAD = ("".join(f"{b ^ x:02X}" for b in _KEY.ljust(64, b"\0")) for x in (0x36, 0x5C))


@query(f"SELECT doc_id, sha256(unhex('{_OPAD}' || sha256(unhex('{_IPAD}' || hex(encode(text)))))) AS tag, doc_id % 8 <> 3 AS valid FROM documents")
def signed_tags(spark, sf):
    """Keyed digests of documents, and whether they hold where one in eight texts was changed."""
    docs = _t(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data")).withColumn("tag", archives.hmac_sha256(_KEY, F.col("data")))
    seen = F.when(F.col("doc_id") % 8 == 3, F.concat("data", F.lit(b"!"))).otherwise(F.col("data"))
    return docs.select("doc_id", "tag", (archives.hmac_sha256(_KEY, seen) == F.col("tag")).alias("valid"))


@query("""WITH o AS (SELECT 'n' || (o_orderkey % 5000) AS id, o_orderkey % 7 AS class_tag FROM orders), old AS (SELECT DISTINCT id FROM o WHERE class_tag < 3), new AS (SELECT DISTINCT id FROM o)
  SELECT id, id IN (SELECT id FROM old) AS known FROM new UNION SELECT id, true FROM old""")
def graph_add_nodes(spark, sf):
    """All nodes added to those of three classes; an id that is there stays once."""
    rows = _t(spark, sf, "orders").select(F.concat(F.lit("n"), (F.col("o_orderkey") % 5000).cast("string")).alias("id"), (F.col("o_orderkey") % 7).alias("class_tag"))
    old = rows.where("class_tag < 3").select("id").distinct().withColumn("known", F.lit(True))
    return records.add_nodes(old, rows.select("id", F.lit(False).alias("known")))


@query("""SELECT 'o' || o_orderkey AS id, o_custkey % 7 AS expected, CASE WHEN o_orderkey % 9 <> 2 THEN o_orderkey % 7 END AS actual,
  CASE WHEN o_orderkey % 9 = 2 THEN 'missing' WHEN o_custkey % 7 = o_orderkey % 7 THEN 'found' ELSE 'class mismatch' END AS outcome FROM orders""")
def graph_typed_view(spark, sf):
    name = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")
    rows = _t(spark, sf, "orders").select(name, (F.col("o_orderkey") % 7).alias("class_tag"), (F.col("o_custkey") % 7).alias("expected"), "o_orderkey")
    return records.typed_view(rows.where("o_orderkey % 9 <> 2"), rows.select("id", "expected"))


@query("""WITH e AS (SELECT 'o' || o_orderkey AS id, 'promotion:board|' || o_orderpriority AS p FROM orders WHERE o_orderkey % 7 = 2)
  SELECT sha256('0|' || length(p) || ':' || p || '|' || length(id) || ':' || id) AS id, id AS parent, 0 AS class_tag, NULL::DOUBLE AS unc FROM e""")
def graph_promote(spark, sf):
    k = F.col("o_orderkey")
    nodes = _t(spark, sf, "orders").select(F.concat(F.lit("o"), k.cast("string")).alias("id"), (k % 7).cast("int").alias("class_tag"), F.col("o_orderpriority").alias("payload"), F.col("o_totalprice").alias("unc"))
    return records.promote(nodes, "board").select("id", F.col("parents")[0].alias("parent"), "class_tag", "unc")


_RECS = "r AS (SELECT c_custkey AS rec, 'n' || c_nationkey || '/' || substr(c_mktsegment, 1, 1) AS dir, c_custkey % 3 AS a, c_custkey % 4 AS b FROM customer)"
_SIDES = """x AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'n' || s_nationkey ELSE 'n' || s_nationkey || '/B' END AS dir, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 END AS a, CASE WHEN s_suppkey % 5 < 3 THEN s_suppkey % 4 END AS b,
  CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey END AS rate, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey * 2 END AS gain FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey < 4)"""


@query(f"""WITH {_RECS}, {_SIDES}, f AS (SELECT rec, length(x.dir) AS depth, x.dir AS lev, rate, gain FROM r JOIN x ON (x.dir = '' OR r.dir = x.dir OR starts_with(r.dir, x.dir || '/')) AND (x.a IS NULL OR x.a = r.a) AND (x.b IS NULL OR x.b = r.b)),
  t AS (SELECT rec, min(lev) AS level FROM (SELECT rec, lev FROM f GROUP BY rec, lev HAVING count(*) > 1) GROUP BY rec),
  v AS (SELECT rec, arg_max(rate, depth) FILTER (rate IS NOT NULL) AS rate, arg_max(gain, depth) FILTER (gain IS NOT NULL) AS gain FROM f GROUP BY rec)
  SELECT rec, CASE WHEN level IS NULL THEN rate END AS rate, CASE WHEN level IS NULL THEN gain END AS gain, CASE WHEN level IS NOT NULL THEN 'ambiguous at /' || level WHEN rate IS NULL THEN 'missing rate' WHEN gain IS NULL THEN 'missing gain' END AS problem
  FROM r LEFT JOIN v USING (rec) LEFT JOIN t USING (rec)""")
def sidecar_inheritance(spark, sf):
    """Effective fields of every recording, and where two sidecars of one level or a missing field stand against them."""
    ent = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("c_custkey")
    recs = _t(spark, sf, "customer").select(k.alias("rec"), F.concat(ent("n", F.col("c_nationkey")), F.lit("/"), F.substring("c_mktsegment", 1, 1)).alias("dir"), F.array(ent("a", k % 3), ent("b", k % 4)).alias("ents"))
    s, n = F.col("s_suppkey"), ent("n", F.col("s_nationkey"))
    where = F.when(s % 3 == 0, "").when(s % 3 == 1, n).otherwise(F.concat(n, F.lit("/B")))
    ents = F.array_compact(F.array(F.when(s % 2 == 0, ent("a", s % 3)), F.when(s % 5 < 3, ent("b", s % 4))))
    sides = _t(spark, sf, "supplier").where("s_suppkey % 3 > 0 or s_suppkey < 4").select(where.alias("dir"), ents.alias("ents"), F.when(s % 4 > 0, s).alias("rate"), F.when(s % 7 > 0, s * 2).alias("gain"))
    out = records.sidecar_problems(recs, sides, ["rate", "gain"])
    clear = ~F.coalesce(F.startswith("problem", F.lit("ambiguous")), F.lit(False))
    return out.select("rec", F.when(clear, F.col("rate")).alias("rate"), F.when(clear, F.col("gain")).alias("gain"), "problem")


@query("""WITH c AS (SELECT l_orderkey AS rec, l_linenumber AS ch, 'E' || (l_partkey % 6) AS plus, 'E' || (l_suppkey % 7 + 1) AS minus FROM lineitem),
  e AS (SELECT rec, ch, plus AS shared, 1 AS role FROM c UNION ALL SELECT rec, ch, minus, -1 FROM c),
  p AS (SELECT a.rec, a.ch, b.ch AS parent, a.shared, a.role * b.role AS sign, a.shared IN ('E1', 'E2') AS ref FROM e a JOIN e b ON a.rec = b.rec AND a.shared = b.shared AND b.ch < a.ch),
  q AS (SELECT *, row_number() OVER (PARTITION BY rec, ch, parent ORDER BY ref, shared, sign) AS k FROM p)
  SELECT rec, ch, parent, sign, shared, place FROM (SELECT *, row_number() OVER (PARTITION BY rec, ch ORDER BY ref, parent DESC) AS place FROM q WHERE k = 1) WHERE place <= 3""")
def electrode_forest(spark, sf):
    """The three supports of each channel; a derivation may have one electrode twice."""
    name = lambda c: F.concat(F.lit("E"), c.cast("string"))
    channels = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("ch"), name(F.col("l_partkey") % 6).alias("plus"), name(F.col("l_suppkey") % 7 + 1).alias("minus"))
    return records.electrode_forest(channels, ["E1", "E2"], supports=3)


@query("""WITH c AS (SELECT l_orderkey AS rec, l_linenumber AS ch, l_quantity::BIGINT AS spr, l_returnflag = 'R' AS note FROM lineitem), g AS (SELECT rec, spr, sum(spr)::BIGINT AS w FROM c WHERE NOT note GROUP BY ALL),
  m AS (SELECT rec, arg_max(spr, w * 1000 + spr) AS main FROM g GROUP BY rec) SELECT rec, ch, CASE WHEN note THEN 'annotation' WHEN spr = main THEN 'signal' ELSE 'secondary' END AS path FROM c LEFT JOIN m USING (rec)""")
def channel_diversion(spark, sf):
    label = F.when(F.col("l_returnflag") == "R", "EDF Annotations").otherwise("C3")
    return signal.divert(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("ch"), label.alias("label"), F.col("l_quantity").cast("long").alias("spr")))


_SUMS = "p AS (SELECT a.ch, r.ch AS ref, sum(a.x * r.x)::BIGINT AS xr, sum(r.x * r.x)::BIGINT AS rr FROM s a JOIN s r ON a.t = r.t AND r.ch < a.ch GROUP BY ALL), g AS (SELECT ch, ref, (floor(xr::DOUBLE / rr * 131072)::BIGINT + 1) >> 1 AS gain, row_number() OVER (PARTITION BY ch ORDER BY xr::DOUBLE * xr / rr DESC, ref) AS place FROM p WHERE rr > 0)"


@query(f"WITH {S}, {_SUMS} SELECT ch, ref, gain, place FROM g WHERE place <= 3 AND gain <> 0")
def reference_choice(spark, sf):
    return signal.reference_choice(_s(spark, sf))


@query(f"""WITH {S}, {_SUMS}, k AS (SELECT * FROM g WHERE place <= 3 AND gain <> 0), y AS (SELECT s.ch, s.t, s.x, s.x - coalesce(sum(k.gain * r.x) >> 16, 0) AS y FROM s LEFT JOIN k ON k.ch = s.ch LEFT JOIN s r ON r.ch = k.ref AND r.t = s.t GROUP BY s.ch, s.t, s.x),
  b AS (SELECT ch, sum(abs(y)) < sum(abs(x)) AS used FROM y GROUP BY ch) SELECT ch, t, (CASE WHEN used THEN y ELSE x END)::BIGINT AS y, used FROM y JOIN b USING (ch)""".replace("sum(k.gain * r.x) >> 16", "sum(k.gain * r.x)::BIGINT >> 16"))
def cross_channel_keep_smaller(spark, sf):
    df = _s(spark, sf)
    return signal.keep_smaller(df, signal.reference_choice(df).select("ch", "ref", "gain"))


@query(f"WITH {S} SELECT ch AS name, 'EEG' AS type, 'uV' AS units, 250.0::DOUBLE AS sampling_frequency, count(*) AS n_samples, count(*) FILTER (x * 9 NOT BETWEEN -32768 AND 32767) AS clamped, greatest(least(min(x * 9), 32767), -32768) AS low, greatest(least(max(x * 9), 32767), -32768) AS high FROM s GROUP BY ch")
def bids_channels(spark, sf):
    return signal.channel_table(_s(spark, sf).withColumn("x", F.col("x") * 9))


_LE4 = " || ".join(f"substr(h, {k}, 2)" for k in range(15, 8, -2))


@query(f"WITH {S}, h AS (SELECT ch, t, lpad(to_hex(x), 16, '0') AS h FROM s) SELECT ch, sha256(unhex(string_agg({_LE4}, '' ORDER BY t))) AS digest FROM h GROUP BY ch")
def export_raw_int32(spark, sf):
    """Digest of each channel's raw export: little-endian 32-bit integers in the order of time."""
    return signal.digest(_s(spark, sf).withColumn("name", F.col("ch")), keys=("name",), width=4).withColumnRenamed("name", "ch")


@query(f"""WITH {S}, r AS (SELECT ch, t, ((x + 32768) * 401 + (-200) * 65535) * 65536 AS n FROM s), q AS (SELECT *, n - ((n % 65535) + 65535) % 65535 AS whole, ((n % 65535) + 65535) % 65535 AS rest FROM r)
  SELECT ch, t, whole // 65535 + CASE WHEN rest * 2 > 65535 THEN 1 ELSE 0 END AS q, CASE WHEN (x_ % 4 + 4) % 4 = 2 THEN (x_ - 2) // 4 + CASE WHEN ((x_ - 2) // 4) % 2 <> 0 THEN 1 ELSE 0 END ELSE round(x_ / 4.0)::BIGINT END AS tie FROM (SELECT q.*, s.x AS x_ FROM q JOIN s USING (ch, t))""")
def calibrate_q47_16(spark, sf):
    """Fixed-point calibration with 16 fractional bits, and quarters of samples, where every other tie goes to the even one."""
    q = scalar.q47_16("x", F.lit(-200), F.lit(201), F.lit(-32768), F.lit(32767))
    return _s(spark, sf).select("ch", "t", q.alias("q"), scalar.round_ratio("x", F.lit(4)).alias("tie"))


@query(f"WITH {S}, m AS (SELECT max(abs(x))::DOUBLE AS peak FROM s) SELECT ch, t, round((trunc(x / peak * 0.72 * 2147483647)::FLOAT / 2147483647::FLOAT * 1000::FLOAT)::DOUBLE, 3) AS value FROM s, m")
def q31_to_float(spark, sf):
    return catalogue.q31_normalise(spark, sf).select("ch", "t", F.round(scalar.q31_to_float("q").cast("double"), 3).alias("value"))


@query("""WITH d AS (SELECT p_partkey, p_retailprice::DECIMAL(15, 2) AS v FROM part), n AS (SELECT p_partkey, (v * 100)::BIGINT AS n FROM d)
  SELECT p_partkey, n // gcd(n, 100) AS num, 100 // gcd(n, 100) AS den, NULL::BIGINT AS bad FROM n""")
def decimal_ratio(spark, sf):
    text = F.format_string("%.2f", F.col("p_retailprice").cast("double"))
    r = scalar.decimal_ratio(text)
    return _t(spark, sf, "part").select("p_partkey", r["num"].cast("long").alias("num"), r["den"].cast("long").alias("den"), scalar.decimal_ratio(F.lit("1e5"))["num"].cast("long").alias("bad"))


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::FLOAT::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), k AS (SELECT *, list_filter(range(61), lambda k: x * pow(2, k) = floor(x * pow(2, k)))[1] AS k FROM v)
  SELECT vec_id, i, (x * pow(2, k))::BIGINT AS num, pow(2, k)::BIGINT AS den FROM k""")
def float_ratio(spark, sf):
    rows = _t(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    r = scalar.float_ratio(F.col("x").cast("float"))
    return rows.select("vec_id", "i", r["num"].alias("num"), r["den"].alias("den"))


@query("SELECT page_id, 'out/' || page_id || '-' || 'htm' || '.lml' AS path, coalesce(NULL, 'b' || page_id) AS field FROM pages")
def path_template(spark, sf):
    path = F.concat(F.lit("in/x/"), F.col("page_id").cast("string"), F.lit(".htm"))
    json = F.concat(F.lit('{"b": "b'), F.col("page_id").cast("string"), F.lit('", "c": "c"}'))
    return _t(spark, sf, "pages").select("page_id", scalar.template("out/{stem}-{ext}.lml", path).alias("path"), scalar.first_field(json, ["a", "b", "c"]).alias("field"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::FLOAT) AS v FROM embeddings), p AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM v), s AS (SELECT *, (peak / 32767::FLOAT)::FLOAT AS scale FROM p),
  m AS (SELECT vec_id, scale, v, list_transform(v, lambda x: CASE WHEN scale = 0 THEN 0 ELSE greatest(least(sign(x) * floor((abs((x / scale)::FLOAT) + 0.5::FLOAT)::FLOAT), 32767), -32767) END::BIGINT) AS mant FROM s)
  SELECT vec_id, round(scale::DOUBLE * 1000000, 3) AS scale, list_sum(mant)::BIGINT AS total, list_sum(list_transform(mant, lambda x: abs(x)))::BIGINT AS size,
    list_max(list_transform(range(1, len(v) + 1), lambda i: abs((mant[i]::FLOAT * scale)::FLOAT - v[i]))) <= scale AS close FROM m""")
def bfp_pack(spark, sf):
    """16-bit block floating point of vectors: scale, sum and size of the mantissas, and whether every value comes back within a step."""

    def run(batches):
        import numpy as np

        for pdf in batches:
            packed = [kernels.bfp_quantize(v) for v in pdf["embedding"]]
            pdf["scale"] = [round(float(s) * 1000000, 3) for s, _ in packed]
            pdf["total"], pdf["size"] = [int(m.sum()) for _, m in packed], [int(np.abs(m).sum()) for _, m in packed]
            pdf["close"] = [bool(np.abs(kernels.bfp_dequantize(s, m) - np.asarray(v, dtype=np.float32)).max() <= s) for (s, m), v in zip(packed, pdf["embedding"], strict=True)]
            yield pdf[["vec_id", "scale", "total", "size", "close"]]

    return _t(spark, sf, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, scale double, total long, size long, close boolean")


@query("""WITH RECURSIVE m AS (SELECT conv_id AS log, turn AS line, text AS msg, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL),
  c AS (SELECT log, line, k, repeat('0', 32) AS prev, substr(sha256(repeat('0', 32) || '|' || msg), 1, 32) AS sha FROM m WHERE k = 1
    UNION ALL SELECT m.log, m.line, m.k, c.sha, substr(sha256(c.sha || '|' || m.msg), 1, 32) FROM c JOIN m ON m.log = c.log AND m.k = c.k + 1),
  t AS (SELECT c.*, CASE WHEN c.log % 7 = 0 AND c.line = 1 THEN 'changed' ELSE m.msg END AS msg, CASE WHEN c.log % 11 = 3 AND c.line = 0 THEN 'other' ELSE c.prev END AS seen FROM c JOIN m USING (log, line))
  SELECT log, min(line) AS first_broken, count(*) AS n_broken FROM t WHERE sha <> substr(sha256(seen || '|' || msg), 1, 32) OR seen <> prev GROUP BY log""")
def hash_chain_verify(spark, sf):
    """First broken line of every log, and how many are: one message in seven logs and one link in eleven were changed."""

    def chain(pdf):
        import hashlib

        pdf = pdf.sort_values("line")
        prev, rows = "0" * 32, []
        for m in pdf["msg"]:
            sha = hashlib.sha256(f"{prev}|{m}".encode()).hexdigest()[:32]
            rows.append((prev, sha))
            prev = sha
        pdf["prev"], pdf["sha"] = [p for p, _ in rows], [s for _, s in rows]
        return pdf

    made = catalogue._log(spark, sf).where("msg is not null").groupBy("log").applyInPandas(chain, "log long, line long, msg string, prev string, sha string")
    changed = made.withColumn("msg", F.when((F.col("log") % 7 == 0) & (F.col("line") == 1), F.lit("changed")).otherwise(F.col("msg")))
    changed = changed.withColumn("prev", F.when((F.col("log") % 11 == 3) & (F.col("line") == 0), F.lit("other")).otherwise(F.col("prev")))
    return records.verify_chain(changed, ("log",)).where("broken").groupBy("log").agg(F.min("line").alias("first_broken"), F.count("*").alias("n_broken"))
