"""Walks over manifest trees, timelines and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.scalars import action_display, missing, or_else

#: Hops to a parent at most.
GUARD = 11
#: Values of the key that spreads rows without a node over the tasks.
SPREAD = 1024
#: Specs that are held against every issuer; more are keyed by what they need.
FEW_SPECS = 64


def _spread(node: Column, start: Column | None = None) -> Column:
    """A second join key that follows from the node; without a node from the start, so that those rows don't all meet in one task."""
    return F.pmod(F.xxhash64(node if start is None else F.coalesce(node, start)), F.lit(SPREAD))


def _strides(steps: DataFrame) -> DataFrame:
    """steps (node, held, at: an array of what a step from the node meets, and where it ends, null if the way ends there) four steps long, by doubling twice."""
    for _ in range(2):
        far = steps.select(F.col("node").alias("n"), F.col("held").alias("more"), F.col("at").alias("end"), _spread(F.col("node")).alias("n_spread"))
        both = steps.withColumn("spread", _spread(F.col("at"), F.col("node"))).join(far, (F.col("at") == F.col("n")) & (F.col("spread") == F.col("n_spread")), "left")
        steps = both.select("node", F.when(F.col("more").isNull(), F.col("held")).otherwise(F.concat("held", "more")).alias("held"), F.col("end").alias("at"))
    return steps


def _walk(steps: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """start, held: what up to `most` steps from each start meet, in order.

    Four steps to a join: the table of strides is made by joins of the steps with themselves and shuffled once for all
    that follow. Those that have arrived have no key, so later joins pass them by, spread by their starts.
    """
    start = F.col("start").cast(steps.schema["node"].dataType)
    far = _strides(steps).select("node", F.col("held").alias("more"), F.col("at").alias("end"), _spread(F.col("node")).alias("n_spread"))
    walk = starts.select("start", start.alias("at"), F.array().cast(steps.schema["held"].dataType).alias("held"))
    for left in range(most, 0, -4):
        step = _step(walk, far, start)
        more = F.slice("more", 1, left) if left < 4 else F.col("more")
        walk = step.select("start", F.col("end").alias("at"), F.when(F.col("more").isNull(), F.col("held")).otherwise(F.concat("held", more)).alias("held"))
    return walk.select("start", "held")


def _step(walk: DataFrame, up: DataFrame, start: Column) -> DataFrame:
    return walk.withColumn("spread", _spread(F.col("at"), start)).join(up, (F.col("at") == F.col("node")) & (F.col("spread") == F.col("n_spread")), "left")


def root_walk(edges: DataFrame, starts: DataFrame, most: int = GUARD, doubling: bool = False) -> DataFrame:
    """start, root, depth: from each start up the parents until none is left or after `most` hops.

    edges: node, parent (null at a root). A start that isn't in edges is its own root. An equi-join a hop, for which edges
    are shuffled once; those that have arrived keep a null key, so later joins pass them by, spread by their starts. Where
    about as many start as there are nodes, set doubling: edges are joined into strides of four first, and the starts
    then move by three joins instead of eleven.
    """
    kind = edges.schema["node"].dataType
    start, known = F.col("start").cast(kind), edges.where("node is not null and parent is not null")
    if doubling:
        held = _walk(known.select("node", F.array("parent").alias("held"), F.col("parent").cast(kind).alias("at")), starts, most)
        return held.select("start", F.coalesce(F.try_element_at("held", F.lit(-1)), "start").alias("root"), F.size("held").alias("depth"))
    up = known.select("node", "parent", _spread(F.col("node")).alias("n_spread"))
    walk = starts.select("start", F.col("start").alias("root"), start.alias("at"), F.lit(0).alias("depth"))
    for _ in range(most):
        walk = _step(walk, up, start).select("start", F.coalesce("parent", "root").alias("root"), F.col("parent").cast(kind).alias("at"), (F.col("depth") + F.col("parent").isNotNull().cast("int")).alias("depth"))
    return walk.select("start", "root", "depth")


def root_thumbnail(edges: DataFrame, starts: DataFrame, thumbnails: DataFrame, most: int = GUARD, doubling: bool = False) -> DataFrame:
    """start, thumbnail: the deepest one there is on the way to the root.

    edges: node, parent, ingredient_thumbnail; thumbnails: node, thumbnail. At a node with a parent the parent's result
    counts, else the ingredient's thumbnail, else the node's own; past the guard there is none. Empty ones are missing.
    The nodes' own thumbnails are joined to the edges once; the walk is that of `root_walk`.
    """
    kind = edges.schema["node"].dataType
    up = edges.where("node is not null").select("node", F.col("parent").cast(kind).alias("parent"), F.col("ingredient_thumbnail").alias("i"))
    own = thumbnails.where("node is not null").select(F.col("node").cast(kind).alias("node"), F.col("thumbnail").alias("t"))
    shown = up.join(own, "node", "full").select("node", "parent", or_else("i", "t").alias("shown"))
    if doubling:
        held = _walk(shown.select("node", F.array("shown").alias("held"), F.col("parent").alias("at")), starts, most)
        return held.select("start", F.try_element_at(F.filter("held", lambda x: x.isNotNull()), F.lit(-1)).alias("thumbnail"))
    start, far = F.col("start").cast(kind), shown.withColumn("n_spread", _spread(F.col("node")))
    walk = starts.select("start", start.alias("at"), F.lit(None).cast("string").alias("thumbnail"))
    for _ in range(most):
        walk = _step(walk, far, start).select("start", F.col("parent").alias("at"), F.coalesce("shown", "thumbnail").alias("thumbnail"))
    return walk.select("start", "thumbnail")


def timeline(actions: DataFrame, key: str = "manifest_id") -> DataFrame:
    """key, seq, kind, display: a root card, the actions in order, and the current card.

    actions: key, pos, action. Places come from the rows' own positions, so nothing is sorted.
    """
    last = actions.groupBy(key).agg(F.max("pos").alias("last"))
    cards = F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit("root").alias("kind"), F.lit("").alias("display")),
        F.struct((F.col("last") + 2).cast("long").alias("seq"), F.lit("current").alias("kind"), F.lit("").alias("display")),
    )
    ends = last.select(key, F.inline(cards))
    return ends.union(actions.select(key, (F.col("pos") + 1).cast("long").alias("seq"), F.lit("action").alias("kind"), action_display("action").alias("display")))


def group_assertions(assertions: DataFrame, key: str = "manifest_id", mixed: bool = False) -> DataFrame:
    """key, label, values (in order), multi: one row for each label of a manifest.

    With mixed=True a repeated label whose first data is itself a JSON array is added to, as the display does it: values
    are that array's elements and then the other data.
    """
    held = assertions.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("held"))
    values, multi = F.col("held.data"), F.size("held") > 1
    if mixed:
        inner = F.when(F.ltrim(F.col("held")[0]["data"]).startswith("["), F.from_json(F.col("held")[0]["data"], "array<string>"))
        values = F.when(multi & inner.isNotNull(), F.concat(inner, F.slice("held.data", 2, F.size("held")))).otherwise(values)
    return held.select(key, "label", values.alias("values"), multi.alias("multi"))


def _runs(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.substring(text, k, F.lit(n)))


def _grams(text: Column) -> Column:
    """Hashes of the distinct runs of three characters, and shorter ones, of a text."""
    runs = F.concat(*[F.when(F.length(text) >= n, _runs(text, n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))


def _needed_grams(text: Column) -> Column:
    """Hashes of the distinct runs of three characters of a text, or of the whole of a shorter one. No part of a run is rarer than the run."""
    runs = F.when(F.length(text) >= 3, _runs(text, 3)).otherwise(F.array(text))
    return F.array_distinct(F.transform(runs, lambda r: F.xxhash64(r)))


def _mandatory(matcher: Column, is_regex: Column) -> Column:
    """A text that every name holds which the matcher finds; null where there is none.

    A literal is its own. Of a regex without groups, choices, classes, escapes and flags it is the longest run of plain
    characters that no quantifier makes optional.
    """
    plain = "[A-Za-z0-9 ,&_#:/-]"
    runs = F.regexp_extract_all(matcher, F.lit(rf"{plain}+(?![?*])"), F.lit(0))
    longest = F.try_element_at(F.array_sort(runs, lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    return F.when(~is_regex, matcher).when(matcher.rlike(rf"^(?:{plain}|[.*+?^$])*$"), longest)


def match_spec(rows: DataFrame, specs: DataFrame, issuer: str = "issuer") -> DataFrame:
    """rows with spec_id: the first spec, by place, whose matcher the issuer holds (or that its regex finds); null if none.

    specs: spec_id, place, matcher, is_regex. The distinct issuers are matched, not the rows. Up to FEW_SPECS are held
    against each issuer. Beyond that equal matchers are one, with the first spec's place, and every matcher is keyed by
    the hash of one run of three characters (or fewer) that it needs, the one that fewest matchers have; issuers meet only
    the matchers whose key they hold, by an equi-join, and those are verified.
    Regexes that need no such run, and empty matchers, are still held against all issuers: keep those few.
    """
    names = rows.select(F.col(issuer).alias("name")).where("name is not null").distinct()
    hit = F.when(F.col("is_regex"), F.expr("name rlike matcher")).otherwise(F.contains("name", "matcher"))
    if specs.limit(FEW_SPECS + 1).count() <= FEW_SPECS:
        found = names.join(F.broadcast(specs), hit)  # FEW_SPECS matchers of hand-kept length
    else:
        one = specs.groupBy("matcher", F.coalesce("is_regex", F.lit(False)).alias("is_regex")).agg(F.min_by("spec_id", "place").alias("spec_id"), F.min("place").alias("place"))
        needs = one.withColumn("need", F.nullif(_mandatory(F.col("matcher"), F.col("is_regex")), F.lit("")))
        keys = needs.where("need IS NOT NULL").select("spec_id", "place", "matcher", "is_regex", F.explode(_needed_grams(F.col("need"))).alias("gram"))
        shared = keys.groupBy("gram").agg(F.count("*").alias("specs"))
        # Both sides of min_by are longs, so that this is a hash aggregate: a task holds its matchers, not their runs.
        rarest = keys.join(shared, "gram").groupBy("spec_id", "place", "matcher", "is_regex").agg(F.min_by("gram", "specs").alias("gram"))
        found = names.select("name", F.explode(_grams(F.col("name"))).alias("gram")).join(rarest, "gram").where(hit).select("name", "spec_id", "place")
        rest = needs.where("need IS NULL")
        if not rest.isEmpty():
            found = found.union(names.join(rest, hit).select("name", "spec_id", "place"))
    first = found.groupBy("name").agg(F.min_by("spec_id", "place").alias("spec_id"))
    return rows.join(first, rows[issuer] == first["name"], "left").drop("name")


FIELDS = ["label", "title", "format", "vendor", "instance_id", "issuer", "signed_at", "claim_generator"]


def flatten(manifests: DataFrame, fields: list[str] = FIELDS, key: str = "manifest_id") -> DataFrame:
    """key, place, label, value: the manifest's own fields that aren't empty, then the fields of its assertions.

    assertions, where manifests has it: an array of (label, data), data a map of text. Actions are left out, as are
    null and empty values. Places order a manifest's rows.
    """
    own = F.array(*[F.struct(F.lit(k).cast("long").alias("place"), F.lit(f).alias("label"), F.col(f).cast("string").alias("value")) for k, f in enumerate(fields)])
    out = manifests.select(key, F.inline(own))
    if "assertions" in manifests.columns:
        each = manifests.select(key, F.posexplode("assertions").alias("k", "a")).where("a.label NOT IN ('c2pa.actions', 'c2pa.actions.v2')")
        part = each.select(key, "k", F.col("a.label").alias("name"), F.posexplode(F.map_entries("a.data")).alias("j", "e"))
        out = out.union(part.select(key, (1000 * (F.col("k") + 1) + F.col("j")).cast("long"), F.concat("name", F.lit(" - "), "e.key"), F.col("e.value")))
    return out.where(~missing("value"))
