"""Operators on manifests, archives, logs, rules and evidence graphs."""

import functools
import operator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bioquery.functions import scalar


def first_rule(df: DataFrame, column: str, rules, default=None):
    """Column: the value of the first rule (pattern, value) whose pattern the text contains, in any case."""
    text = F.lower(F.col(column))
    out = functools.reduce(lambda w, rule: w.when(text.contains(rule[0].lower()), rule[1]), rules, F)
    return df.withColumn("matched", out.otherwise(F.lit(default)))


def first_rule_of_group(df: DataFrame, keys, column: str, rules, default=None) -> DataFrame:
    """(keys, matched): the first rule in the list's order that any row of the group matches."""
    index = functools.reduce(lambda w, r: w.when(F.lower(F.col(column)).contains(r[1][0].lower()), r[0]), enumerate(rules), F)
    best = df.groupBy(*keys).agg(F.min(index).alias("rule"))
    name = functools.reduce(lambda w, r: w.when(F.col("rule") == r[0], r[1][1]), enumerate(rules), F)
    return best.select(*keys, name.otherwise(F.lit(default)).alias("matched"))


CLASS_TAGS = {name: tag for tag, name in enumerate(scalar.CLASSES)}


def glob_to_regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern[i : i + 2] == "**":
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        else:
            out += c if c.isalnum() or c in "_/ " else "\\" + c
        i += 1
    return f"^{out}$"


def globs(df: DataFrame, column: str, include, exclude) -> DataFrame:
    """Rows that match any include pattern (all if there is none) and no exclude pattern."""
    any_of = lambda patterns, empty: functools.reduce(operator.or_, [F.col(column).rlike(glob_to_regex(p)) for p in patterns], F.lit(empty))
    return df.where((any_of(include, False) if include else F.lit(True)) & ~any_of(exclude, False))


def sidecar_owner(files: DataFrame, stems: DataFrame) -> DataFrame:
    """(file, stem): the longest stem that a file's name begins with, followed by a dot or underscore.

    Every prefix of a name that ends before a dot or underscore is a key, so the
    join is by equality and its rows grow with the names' separators.
    """
    cuts = F.filter(F.sequence(F.lit(1), F.length("file")), lambda i: F.substring(F.col("file"), i, F.lit(1)).isin(".", "_"))
    prefixes = files.select("file", F.explode(F.transform(cuts, lambda i: F.substring(F.col("file"), F.lit(1), i - 1))).alias("stem"))
    return prefixes.join(stems, "stem").groupBy("file").agg(F.max_by("stem", F.length("stem")).alias("stem"))


def _sidecar_levels(recordings: DataFrame, sidecars: DataFrame, fields) -> DataFrame:
    """(rec, up, depth, n, fields..): of every directory at or above a recording's, how many sidecars fit there and what they set.

    Sidecars of one directory and the same entities fit the same recordings, so
    both sides are matched by kind, once each, and the rows grow with the
    recordings, not with the pairs that fit.  Kinds meet by a sidecar's entity
    that the fewest kinds of recordings below have, or by none.
    """
    kind = F.array_sort(F.array_distinct("ents"))
    recs = recordings.select("rec", "dir", kind.alias("ents")).distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    at = recs.select("dir", "ents").where("ents is not null").distinct().withColumn("up", F.explode(F.array_distinct(ups)))
    of = sidecars.select(F.col("dir").alias("up"), kind.alias("of"), *fields).where("of is not null")
    side = of.groupBy("up", "of").agg(F.count("*").alias("n"), *[F.first(f, ignorenulls=True).alias(f) for f in fields])
    # an entity as a key, null too
    keyed = lambda df, ents: df.withColumn("key", F.explode(F.transform(ents, lambda e: F.coalesce(F.concat(F.lit("="), e), F.lit("")))))
    by_key = keyed(at, "ents")
    often = by_key.groupBy("up", "key").agg(F.count("*").alias("often"))
    rarest = keyed(side.select("up", "of"), "of").join(often, ["up", "key"], "left").groupBy("up", "of").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key"))["key"].alias("key"))
    some = by_key.join(side.join(rarest, ["up", "of"]), ["up", "key"]).where(F.size(F.array_except("of", "ents")) == 0)
    names = ["dir", "ents", "up", "n", *fields]
    fits = some.select(*names).unionByName(at.join(side.where(F.size("of") == 0), "up").select(*names))
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.first(f, ignorenulls=True).alias(f) for f in fields])
    return sums(recs.join(sums(fits, "dir", "ents", "up"), ["dir", "ents"]), "rec", "up").withColumn("depth", F.length("up"))


def _deepest(fields):
    return [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("depth"))).alias(f) for f in fields]


def sidecar_fields(recordings: DataFrame, sidecars: DataFrame, fields) -> DataFrame:
    """Effective fields of recordings (rec, dir, ents): of sidecars (dir, ents, fields) in their directory or above
    whose entities the recording has, the deepest that sets a field gives it."""
    return _sidecar_levels(recordings, sidecars, fields).groupBy("rec").agg(*_deepest(fields))


def sidecar_problems(recordings: DataFrame, sidecars: DataFrame, fields) -> DataFrame:
    """(rec, fields.., problem): effective fields, and why they can't be had.

    Two sidecars that fit at one level are ambiguous; else the first field that
    none of them sets is missing; else the problem is null.
    """
    of = _sidecar_levels(recordings, sidecars, fields).groupBy("rec").agg(*_deepest(fields), F.min(F.when(F.col("n") > 1, F.col("up"))).alias("level"))
    out = recordings.select("rec").distinct().join(of, "rec", "left")
    problem = F.when(F.col("level").isNotNull(), F.concat(F.lit("ambiguous at /"), "level"))
    for f in fields:
        problem = problem.when(F.col(f).isNull(), f"missing {f}")
    return out.select("rec", *fields, problem.alias("problem"))


def electrode_forest(channels: DataFrame, references, supports=1) -> DataFrame:
    """(rec, ch, parent, sign, shared, place) of channels (rec, ch, plus, minus): earlier channels that share an electrode.

    Those that share one that isn't a reference come first, the latest of each
    kind before earlier ones; of two shared electrodes a non-reference counts,
    then the first by name.  sign is -1 where the roles differ.  Channels without
    electrodes have no parent.
    """
    ends = channels.select("rec", "ch", F.explode(F.array(F.struct(F.col("plus").alias("shared"), F.lit(1).alias("role")), F.struct(F.col("minus").alias("shared"), F.lit(-1).alias("role")))).alias("e")).select("rec", "ch", "e.*").where("shared is not null")
    prior = ends.select("rec", F.col("ch").alias("parent"), "shared", F.col("role").alias("other"))
    both = ends.join(prior, ["rec", "shared"]).where("parent < ch")
    rank = F.struct(F.col("shared").isin(*references).alias("reference"), "shared", (F.col("role") * F.col("other")).alias("sign"))
    pairs = both.groupBy("rec", "ch", "parent").agg(F.min(rank).alias("best")).select("rec", "ch", "parent", "best.*")
    order = W.partitionBy("rec", "ch").orderBy("reference", F.desc("parent"))
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= supports).select("rec", "ch", "parent", "sign", "shared", "place")


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): the first failure of missing, size (only if one is expected) and content; else OK.

    sha256 of files is that of the decoded signal; null: it could not be decoded.
    """
    have = files.select("path", F.col("size").alias("have_size"), F.col("sha256").alias("have_sha"), F.lit(True).alias("there"))
    size = (F.col("size") > 0) & (F.col("size") != F.col("have_size"))
    status = F.when(F.col("there").isNull(), "MISSING").when(size, "SIZE MISMATCH").when(F.col("sha256") != F.col("have_sha"), "SHA256 MISMATCH").when(F.col("have_sha").isNull(), "DECODE FAIL").otherwise("OK")
    return manifest.join(have, "path", "left").select("path", status.alias("status"))


def chain_hash(prev, msg):
    return F.substring(F.sha2(F.concat(prev, F.lit("|"), msg).cast("binary"), 256), 1, 32)


def verify_chain(log: DataFrame, keys=()) -> DataFrame:
    """Lines (line, prev, sha, msg) whose hash is wrong or whose prev isn't the hash of the line before.

    keys part independent logs; each is put in order once.
    """
    order = W.partitionBy(*keys).orderBy("line")
    broken = (F.col("sha") != chain_hash(F.col("prev"), F.col("msg"))) | (F.col("prev") != F.coalesce(F.lag("sha").over(order), F.lit("0" * 32)))
    return log.withColumn("broken", broken)


def archive_summary(entries: DataFrame) -> DataFrame:
    """Files, bytes and ratio by method."""
    return entries.groupBy("method").agg(F.count("*").alias("n_files"), F.sum("original_size").alias("original"), F.sum("compressed_size").alias("compressed"), (F.sum("original_size") / F.sum("compressed_size")).alias("cr"))


def verify_archive(entries: DataFrame, keys=("archive",)) -> DataFrame:
    """Roll-up of checked entries (ok boolean): passed only if all are."""
    return entries.groupBy(*keys).agg(F.bool_and("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.sum("original_size").alias("original"), F.count("*").alias("n_files"))


RANGES = 64  # parts of a key's order that are summed apart


def running_total(df: DataFrame, keys, order: str, value: str, name: str, ranges=RANGES) -> DataFrame:
    """df with a column of the sum of value over the rows of its key that come before by order; order is unique in a key.

    The order is cut into ranges at borders from a bounded sample of it, which
    only decides how evenly they are filled: sums of ranges come first, then
    those inside each, so one key is many tasks'.
    """
    step = max(1, df.count() // (32 * ranges))
    sample = sorted(r[0] for r in df.where(F.pmod(F.xxhash64(order), F.lit(step)) == 0).select(order).distinct().limit(256 * ranges).collect() if r[0] is not None)
    borders = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    place = functools.reduce(lambda w, at: w.when(F.col(order) >= F.lit(borders[at - 1]), at), range(len(borders), 0, -1), F)
    dealt = df.withColumn("__range", place.otherwise(F.lit(0)) if borders else F.lit(0))
    sums = dealt.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    zero = F.lit(0).cast("long")
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), zero)
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), zero)
    starts = sums.select(*keys, "__range", before.alias("__before"))
    return dealt.withColumn("__inside", inside).join(starts, [*keys, "__range"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def places(df: DataFrame, keys, order, name: str, ranges=16) -> DataFrame:
    """df with a column of the row's place in its key by the order's columns, from 0, null values first; one key is many tasks'.

    As in running_total a sample only decides how evenly ranges are filled: a
    row's range is how many borders it has reached, which no border can put out
    of order.
    """
    order, kinds = list(order), dict(df.dtypes)
    step = max(1, df.count() // (32 * ranges))
    some = df.where(F.pmod(F.xxhash64(*order), F.lit(step)) == 0).select(*order).dropna().distinct().limit(256 * ranges)
    sample = some.orderBy(*order).select(*[F.col(c).cast("string") for c in order]).collect()
    borders = list(dict.fromkeys(tuple(sample[len(sample) * k // ranges]) for k in range(1, ranges))) if sample else []

    def reached(border):
        out = F.lit(True)
        for c, v in reversed(list(zip(order, border, strict=True))):
            at = F.lit(v).cast(kinds[c])
            out = (F.col(c) > at) | ((F.col(c) == at) & out)
        return F.coalesce(out, F.lit(False)).cast("int")

    dealt = df.withColumn("__range", functools.reduce(operator.add, map(reached, borders), F.lit(0)))
    sums = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__of"), before.alias("__before"))
    inside = F.row_number().over(W.partitionBy(*keys, "__range").orderBy(*order)) - 1
    same = functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__range") == F.col("__of"))
    out = dealt.withColumn("__inside", inside).join(F.broadcast(starts), same)  # a row a range of a key
    return out.select(*df.columns, (F.col("__before") + F.col("__inside")).cast("long").alias(name))


def offsets(entries: DataFrame, keys=("archive",), ranges=RANGES) -> DataFrame:
    """Start of each payload: the sizes of those before it, by path."""
    return running_total(entries, list(keys), "path", "compressed_size", "offset", ranges)


def append(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Outcome for new entries (path, sha256): an equal one is a no-op, other content under a path a conflict."""
    old = entries.select("path", F.col("sha256").alias("old"))
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("old") == F.col("sha256"), "unchanged").otherwise("conflict")
    return new.join(old, "path", "left").select("path", outcome.alias("outcome"))


def duplicates(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def edit_metadata(column, overlay: dict, put: dict, drop):
    """Map column after an overlay, then single values, then removals, in that order."""
    lit_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    out = column
    for layer in (overlay, put):
        if layer:
            out = F.map_concat(_without(out, layer), lit_map(layer))
    return _without(out, drop) if drop else out


def _without(column, names):
    return F.map_filter(column, lambda k, _: ~k.isin(*names))


def node_id(class_tag, payload, parents):
    """Content address: class, payload and sorted parents, each with its length before it."""
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(class_tag.cast("string"), F.lit("|"), sized(payload), F.lit("|"), F.array_join(F.transform(F.array_sort(parents), sized), "")).cast("binary"), 256)


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes and those of new whose id isn't there yet, once each: equal ids mean equal content."""
    return nodes.unionByName(new.dropDuplicates(["id"]).join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))


def typed_view(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, expected, actual, outcome) of wanted (id, expected): 'found', 'class mismatch', or 'missing'."""
    have = nodes.select("id", F.col("class_tag").alias("actual"))
    outcome = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("expected"), "found").otherwise("class mismatch")
    return wanted.join(have, "id", "left").select("id", "expected", "actual", outcome.alias("outcome"))


def promote(nodes: DataFrame, authority: str) -> DataFrame:
    """Measured nodes from estimated ones: a new address, the estimate as the one parent, no uncertainty.

    Only estimated nodes are promoted; the estimates stay as they are.
    """
    estimated = nodes.where(F.col("class_tag") == CLASS_TAGS["estimated"])
    process = F.lit(f"promotion:{authority}")
    tag, parents = F.lit(CLASS_TAGS["measured"]), F.array("id")
    return estimated.select(node_id(tag, F.concat(process, F.lit("|"), "payload"), parents).alias("id"), tag.alias("class_tag"), "payload", parents.alias("parents"), F.lit(None).cast("double").alias("unc"), process.alias("process"))


def dangling_parents(nodes: DataFrame) -> DataFrame:
    parents = nodes.select("id", F.explode("parents").alias("parent"))
    return parents.join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent")


def missing_provenance_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst) from parents that nodes name and edges lack."""
    wanted = nodes.select(F.explode("parents").alias("src"), F.col("id").alias("dst")).distinct()
    return wanted.join(edges.where("class = 'provenance-dependency'"), ["src", "dst"], "left_anti")


def verify_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All violations as (kind, id, detail): duplicate and mismatched ids, unknown classes, uncertainty that isn't finite,
    parents and edge ends that don't exist."""
    text = lambda c: c.cast("string")
    none = F.lit("")
    again = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("kind"), "id", text(F.col("n") - 1).alias("detail"))
    wrong = nodes.where(F.col("address") != F.col("stored")).select(F.lit("id_mismatch"), "id", none)
    unknown = nodes.where(scalar.class_name("class_tag").isNull()).select(F.lit("unknown_class"), "id", text(F.col("class_tag")))
    infinite = nodes.where(F.isnan("unc") | (F.abs("unc") == float("inf"))).select(F.lit("non_finite_uncertainty"), "id", none)
    parent = dangling_parents(nodes).select(F.lit("dangling_parent"), "id", text(F.col("parent")))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(nodes.select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n")).select(F.lit("dangling_edge"), "id", text(F.col("n")))
    return functools.reduce(DataFrame.union, (again, wrong, unknown, infinite, parent, ends))


def graph_address(nodes: DataFrame) -> DataFrame:
    """One address of a set of nodes, whatever their order: hashes of 4,096 buckets of sorted ids, hashed.

    A bucket's ids are sorted by Spark and stream through its hash; what meets in
    one task at the end are the buckets' hashes.
    """
    ids = nodes.select(F.substring("id", 1, 3).alias("b"), "id").distinct()

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, sha, done = None, None, []
        for batch in batches:
            for b, node in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = b, hashlib.sha256(node.encode())
                else:
                    sha.update(b"," + node.encode())
        if sha is not None:
            done.append((now, sha.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names=["b", "h"])

    buckets = ids.repartition("b").sortWithinPartitions("b", "id").mapInArrow(run, "b string, h string")
    return buckets.groupBy().agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ",").cast("binary"), 256).alias("address"))


def reconcile_clocks(offsets_seen: DataFrame) -> DataFrame:
    """By stream: the last offset seen, the spread as uncertainty, and the time since it holds."""
    return offsets_seen.groupBy("stream").agg(F.max_by("offset", "seq").alias("offset"), (F.max("offset") - F.min("offset")).alias("uncertainty"), F.max_by("collected", "seq").alias("valid_from"))
