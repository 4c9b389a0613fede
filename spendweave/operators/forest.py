"""Forests of ``(id, parent_id)`` links: roots, rings, the numbers of a walk, descendants and link checks.

Every operator here takes a number of rounds that grows with the logarithm of the rows of a family, whatever its shape.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendweave.session import cut, ranked, spread_join

#: Places of a walk that share a bucket in the join of intervals with places.
BUCKET = 64
#: Tables of finished rows that a round may read beside the open ones; more are written as one.
TABLES = 4


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _finished(tables: list[DataFrame]) -> list[DataFrame]:
    """The finished rows of all rounds so far. Each round adds a table, and reading all of them makes later rounds ever longer."""
    return tables if len(tables) <= TABLES else [cut(_union(tables))[0]]


def _climb(links: DataFrame) -> tuple[DataFrame, int]:
    """Pointer doubling over ``(id, parent)``. Returns rows ``(id, parent, orphan, anc, hops, low, done)``,
    ``low`` being the smallest id on the way to ``anc``, and how many rows never finish. Each round doubles the distance covered; a finite chain always has a row at
    every depth, so a round that finishes no row proves that the open rows lead into cycles."""
    heads = links.select(F.col("id").alias("anc"), F.col("parent").alias("_grand"), F.lit(True).alias("_found"))
    linked = spread_join(links.where(F.col("parent").isNotNull()).withColumn("anc", F.col("parent")), heads, "anc", spread_by="id", how="left")
    top = F.lit(None).cast("boolean")
    tops = links.where(F.col("parent").isNull()).select("id", "parent", F.lit(None).cast("long").alias("_grand"), top.alias("_found"))
    start = linked.select("id", "parent", "_grand", "_found").unionByName(tops).select(
        "id",
        "parent",
        (F.col("parent").isNotNull() & F.col("_found").isNull()).alias("orphan"),
        F.when(F.col("_found"), F.col("parent")).otherwise(F.col("id")).alias("anc"),
        F.when(F.col("_found"), 1).otherwise(0).cast("long").alias("hops"),
        F.col("id").alias("low"),
        (F.col("_found").isNull() | F.col("_grand").isNull()).alias("done"),
    )
    state, seen = cut(start, pending=F.count_if(~F.col("done")))
    pending, finished, opened = seen["pending"], [state.where("done")], state.where("not done")
    while pending:
        lookup = _union([*finished, opened]).select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("hops").alias("_hops"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        moved = spread_join(opened, lookup, "anc", spread_by="id").select(
            "id", "parent", "orphan", F.col("_anc").alias("anc"), (F.col("hops") + F.col("_hops")).alias("hops"), F.least("low", "_low").alias("low"), F.col("_done").alias("done")
        )
        moved, seen = cut(moved, pending=F.count_if(~F.col("done")))
        finished, opened = _finished([*finished, moved.where("done")]), moved.where("not done")
        if seen["pending"] == pending:
            break
        pending = seen["pending"]
    return _union([*finished, opened]), pending


def _rings(open_rows: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """Rows on a cycle, with the cycle's smallest id, how many they are, and for every open row one ``anc`` of them that it leads to,
    going on from where climbing stopped. The images under
    repeated doubling shrink to the cycle rows exactly when their number stops falling; the smallest id on
    the way is final once a round changes none."""
    ring = open_rows.select("id", "anc", "low")
    images = ring.select("anc").distinct().count()
    while True:
        lookup = ring.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("low").alias("_low"))
        ring, seen = cut(
            ring.join(lookup, "anc").select("id", F.col("_anc").alias("anc"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("_fell")),
            fell=F.count_if("_fell"),
        )
        ring = ring.drop("_fell")
        now = ring.select("anc").distinct().count()
        if now == images and not seen["fell"]:
            break
        images = now
    on_ring = ring.select(F.col("anc").alias("id")).distinct()
    return ring.join(on_ring, "id", "left_semi").select("id", F.col("low").alias("ring_root")), now, ring.select("id", "anc")


def resolve_roots(nodes: DataFrame) -> DataFrame:
    """``id, root_id, depth, is_orphan, in_cycle`` for every row of ``nodes(id, parent_id)``.

    A missing parent makes a row an orphan and its own root. A cycle, and everything hanging from it, is
    rooted at the cycle's smallest id; depth there counts the distinct rows on the way up, less one.
    """
    return _resolve(cut(nodes.select("id", "parent_id"))[0])


def _resolve(nodes: DataFrame) -> DataFrame:
    state, looping = _climb(nodes.select("id", F.col("parent_id").alias("parent")))
    flat = state.where("done").select("id", F.col("anc").alias("root_id"), F.col("hops").alias("depth"), F.col("orphan").alias("is_orphan"), F.lit(False).alias("in_cycle"))
    if not looping:
        return flat
    open_rows = state.where(~F.col("done")).select("id", "parent", "anc", "low")
    rings, members, _ = _rings(open_rows)
    sizes = rings.groupBy("ring_root").agg((F.count(F.lit(1)) - 1).alias("_around"))
    rings = rings.join(sizes, "ring_root")
    looped = rings.select("id", F.col("ring_root").alias("root_id"), F.col("_around").alias("depth"))
    if members < looping:
        heads = rings.select("id", F.lit(True).alias("_ring"))
        cut_links = open_rows.join(heads, "id", "left").select("id", F.when(F.col("_ring").isNull(), F.col("parent")).alias("parent"))
        tails, _ = _climb(cut_links)
        entry = rings.select(F.col("id").alias("anc"), "ring_root", "_around")
        looped = spread_join(tails, entry, "anc", spread_by="id").select(
            "id", F.col("ring_root").alias("root_id"), (F.col("hops") + F.col("_around")).alias("depth")
        )
    return flat.unionByName(looped.select("*", F.lit(False).alias("is_orphan"), F.lit(True).alias("in_cycle")))


def _known_links(nodes: DataFrame) -> DataFrame:
    """``id, parent_id, up``: the parent where it is a row itself, else null."""
    heads = nodes.select(F.col("id").alias("parent_id"), F.col("id").alias("up"))
    return spread_join(nodes, heads, "parent_id", spread_by="id", how="left").select("id", "parent_id", "up")


def _tour(nodes: DataFrame) -> tuple[DataFrame, int]:
    """Number the rows ``(id, up)`` by a walk around each tree. Returns ``(id, root_id, depth, at, size, done)`` and how many never finish.

    The walk enters and leaves every row; where it goes next is known from the row's first child, next sibling and parent, so the
    walk is a linked list of twice the rows. Each round doubles the stretch that a step has summed up. Within a list no two steps
    point to the same one, so a parent of very many children is no hot key: siblings are found in one distributed sort.
    ``at`` counts rows from here to the walk's end, ``size`` rows below and itself; rows below have places in ``(at - size, at)``.
    A walk without an end is one around a ring: a round that finishes no step proves that only such are left.
    """
    nodes, _ = cut(nodes.select("id", "up"))
    order = ranked(nodes.where("up is not null"), [F.col("up").asc(), F.col("id").asc()], "_n")
    after = order.select(F.col("up").alias("_up"), F.col("id").alias("_sibling"), (F.col("_n") - 1).alias("_n"))
    siblings = order.join(after, "_n", "left").select("id", F.when(F.col("_up") == F.col("up"), F.col("_sibling")).alias("_sibling"))
    children = order.groupBy(F.col("up").alias("id")).agg(F.min("id").alias("_child"))
    both = nodes.join(children, "id", "left").join(siblings, "id", "left")
    enter, leave = (lambda c: c * 2), (lambda c: c * 2 + 1)
    steps = F.array(
        F.struct(enter(F.col("id")).alias("step"), F.coalesce(enter(F.col("_child")), leave(F.col("id"))).alias("next"), F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("net")),
        F.struct(leave(F.col("id")).alias("step"), F.coalesce(enter(F.col("_sibling")), leave(F.col("up"))).alias("next"), F.lit(0).cast("long").alias("rows"), F.lit(-1).cast("long").alias("net")),
    )
    start = both.select(F.explode(steps).alias("s")).select("s.*").withColumn("last", F.when(F.col("next").isNull(), F.shiftright("step", 1)))
    state, seen = cut(start, open=F.count_if(F.col("next").isNotNull()))
    left, finished, opened = seen["open"], [state.where("next is null")], state.where("next is not null")
    while left:
        lookup = _union([*finished, opened]).select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("rows").alias("_rows"), F.col("net").alias("_net"), F.col("last").alias("_last"))
        moved = opened.join(lookup, "next").select(
            "step", F.col("_next").alias("next"), (F.col("rows") + F.col("_rows")).alias("rows"), (F.col("net") + F.col("_net")).alias("net"), F.col("_last").alias("last")
        )
        moved, seen = cut(moved, open=F.count_if(F.col("next").isNotNull()))
        finished, opened = _finished([*finished, moved.where("next is null")]), moved.where("next is not null")
        if seen["open"] == left:
            break
        left = seen["open"]
    entered = F.col("step") % 2 == 0
    numbers = _union([*finished, opened]).groupBy(F.shiftright("step", 1).alias("id")).agg(
        F.max("last").alias("root_id"), F.max(F.when(entered, -F.col("net"))).alias("depth"), F.max(F.when(entered, F.col("rows"))).alias("at"),
        F.sum(F.when(entered, F.col("rows")).otherwise(-F.col("rows"))).alias("size"), F.max("next").isNull().alias("done"),
    )
    return numbers, left


def numbered(links: DataFrame) -> DataFrame:
    """``id, parent_id, root_id, depth, at, size, on_ring, ring_len, tree_size`` of every row of ``links(id, parent_id)``.

    Rows below a row have the same ``root_id`` and places ``at`` in ``(at - size, at)`` of it. A ring is cut above its smallest id,
    which is the root of the ring and of all that hangs from it; rows ``on_ring`` stand above every row of that tree. A row with
    an unknown parent is a root. Ids are unique, and below 2 to the 62nd.
    """
    nodes, _ = cut(_known_links(links.select("id", "parent_id")))
    numbers, looping = _tour(nodes)
    none = F.lit(None).cast("long")
    columns = ["id", "parent_id", "root_id", "depth", "at", "size", "on_ring", "ring_len", "tree_size"]
    if not looping:
        return nodes.join(numbers, "id").select("id", "parent_id", "root_id", "depth", "at", "size", F.lit(False).alias("on_ring"), none.alias("ring_len"), none.alias("tree_size"))
    numbers, _ = cut(numbers)
    flat = nodes.join(numbers.where("done"), "id").select("id", "parent_id", "root_id", "depth", "at", "size", F.lit(False).alias("on_ring"), none.alias("ring_len"), none.alias("tree_size"))
    loose, _ = cut(nodes.join(numbers.where("not done").select("id"), "id", "left_semi"))
    tops = _resolve(loose.select("id", F.col("up").alias("parent_id"))).where("id = root_id").select("id", F.lit(True).alias("_top"))
    opened, _ = cut(loose.join(tops, "id", "left").select("id", "parent_id", "up", F.coalesce("_top", F.lit(False)).alias("_top")))
    again, _ = cut(_tour(opened.select("id", F.when(~F.col("_top"), F.col("up")).alias("up")))[0].drop("done"))
    lasts = opened.where("_top").select(F.col("id").alias("root_id"), F.col("up").alias("id")).join(again.select("id", "at", "depth"), "id")
    rings = lasts.join(again.where("id = root_id").select("root_id", F.col("size").alias("tree_size")), "root_id")
    rings = rings.select("root_id", F.col("at").alias("_last_at"), (F.col("depth") + 1).alias("ring_len"), "tree_size")
    looped = spread_join(opened.select("id", "parent_id").join(again, "id"), rings, "root_id", spread_by="id")
    on_ring = (F.col("at") - F.col("size") < F.col("_last_at")) & (F.col("_last_at") <= F.col("at"))
    return flat.unionByName(looped.withColumn("on_ring", on_ring).select(columns))


def _below(at: Column, upper_at: Column, upper_size: Column) -> Column:
    return (at > upper_at - upper_size) & (at < upper_at)


def descendant_counts(links: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """``id, descendants``: how many other rows stand below each row."""
    return (numbered(links) if numbers is None else numbers).select("id", (F.when(F.col("on_ring"), F.col("tree_size")).otherwise(F.col("size")) - 1).alias("descendants"))


def descendants(seeds: DataFrame, links: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """``(seed_id, id, level)`` for every descendant of every seed, safe on rings; ``numbers`` are those of :func:`numbered`.

    What stands below a seed has places in one interval, so the pairs are a join of intervals with places by buckets: an interval
    is one row per bucket it touches, and a family of any size is spread over its buckets.
    """
    if numbers is None:
        numbers, _ = cut(numbered(links))
    given = seeds.select(F.col("seed_id").alias("id")).distinct().join(numbers, "id")
    low, high = F.when(F.col("on_ring"), 0).otherwise(F.col("at") - F.col("size")), F.when(F.col("on_ring"), F.col("tree_size")).otherwise(F.col("at") - 1)
    spans = given.select(
        F.col("id").alias("seed_id"), "root_id", "on_ring", F.col("depth").alias("_depth"), F.col("at").alias("_at"), F.col("size").alias("_size"),
        F.col("ring_len").alias("_ring_len"), low.alias("_low"), high.alias("_high"),
    ).where("_high > _low")
    spans = spans.withColumn("_bucket", F.explode(F.expr(f"sequence((_low + 1) div {BUCKET}, _high div {BUCKET})")))
    places = numbers.select("id", "root_id", "depth", "at", F.expr(f"at div {BUCKET}").alias("_bucket"))
    level = F.col("depth") - F.col("_depth")
    return (
        spans.join(places, ["root_id", "_bucket"]).where("at > _low AND at <= _high AND id <> seed_id")
        .select("seed_id", "id", F.when(F.col("on_ring") & ~_below(F.col("at"), F.col("_at"), F.col("_size")), level + F.col("_ring_len")).otherwise(level).alias("level"))
    )


def _standing(proposals: DataFrame, rows: DataFrame) -> DataFrame:
    """``proposals`` with ``verdict`` self, missing or already where a link's own rows tell, and the supplier's parent as ``_now``."""
    have = rows.select(F.col("id").alias("supplier_id"), F.col("parent_id").alias("_now"), F.lit(True).alias("_mine"))
    known = rows.select(F.col("id").alias("parent_id"), F.lit(True).alias("_theirs"))
    checked = spread_join(proposals.join(have, "supplier_id", "left"), known, "parent_id", spread_by="supplier_id", how="left")
    verdict = (
        F.when(F.col("supplier_id") == F.col("parent_id"), "self")
        .when(F.col("_mine").isNull() | F.col("_theirs").isNull(), "missing")
        .when(F.col("_now") == F.col("parent_id"), "already")
    )
    return checked.withColumn("verdict", verdict).drop("_mine", "_theirs")


def link_guard(proposals: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdict per proposed link ``(supplier_id, parent_id)``, each by itself: self, already, missing, cycle or ok.

    A link closes a cycle when the supplier stands above the proposed parent, which the numbers of both tell.
    """
    numbers, _ = cut(numbered(rows))
    mine = numbers.select(F.col("id").alias("supplier_id"), F.col("root_id").alias("_root"), F.col("at").alias("_at"), F.col("size").alias("_size"), "on_ring")
    theirs = numbers.select(F.col("id").alias("parent_id"), F.col("root_id").alias("_their_root"), F.col("at").alias("_their_at"))
    checked = spread_join(_standing(proposals, rows).join(mine, "supplier_id", "left"), theirs, "parent_id", spread_by="supplier_id", how="left")
    above = (F.col("_root") == F.col("_their_root")) & (F.col("on_ring") | _below(F.col("_their_at"), F.col("_at"), F.col("_size")))
    return checked.select("supplier_id", "parent_id", F.coalesce("verdict", F.when(above, "cycle").otherwise("ok")).alias("verdict"))


def _rings_of(nodes: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """``id, ring_root`` of the rows ``(id, parent)`` that stand on a ring, and of all that lead into one; none if there is no ring."""
    state, looping = _climb(cut(nodes)[0])
    if not looping:
        return None
    rings, _, led = _rings(state.where(~F.col("done")).select("id", "anc", "low"))
    rings, _ = cut(rings)
    return rings, spread_join(led, rings.withColumnRenamed("id", "anc"), "anc", spread_by="id").select("id", "ring_root")


def _closing(fallen: DataFrame, led: DataFrame) -> DataFrame | None:
    """Rings ``(ring_root)`` that lead into a ring again when each is opened at one supplier, which falls back to ``_back``; none if all end.

    All rows that led into an opened ring lead to that supplier, so a ring is one row here, with the ring that it falls back into as its parent.
    """
    back = fallen.join(led.select(F.col("id").alias("_back"), F.col("ring_root").alias("_into")), "_back", "left")
    opened = fallen.select(F.col("ring_root").alias("_into"), F.lit(True).alias("_opened"))  # a ring of stored links alone stays as it is
    nodes = back.join(opened, "_into", "left").select(F.col("ring_root").alias("id"), F.when(F.col("_opened"), F.col("_into")).alias("parent"))
    state, looping = _climb(cut(nodes)[0])
    return cut(state.where(~F.col("done")).select(F.col("id").alias("ring_root")))[0] if looping else None


def link_batch(proposals: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdict per proposed link ``(request_id, supplier_id, parent_id)`` when all of a batch are to hold together.

    All links that are neither ``self``, ``missing`` nor ``already`` are put in, of a supplier's several the one with the largest
    request_id. From each ring that has new links, the one with the largest request_id is refused (``cycle``); its supplier falls
    back to an earlier link of the batch, or to the parent it has. This is repeated until no ring has a new link, so mutual
    links of one batch never both pass; rings of stored links alone are left as they are. Other links are ``ok``. Request ids are
    unique. All rows are climbed once; then only what leads into a ring that the refused links' suppliers close again by falling back.
    """
    checked, _ = cut(_standing(proposals, rows).drop("_now"))
    put = checked.where("verdict is null").select("request_id", "supplier_id", "parent_id")
    nodes, live, refused = rows.select("id", "parent_id"), put, None
    while True:
        latest = live.groupBy("supplier_id").agg(F.max("request_id").alias("request_id"), F.max_by("parent_id", "request_id").alias("_up"))
        latest, _ = cut(latest.withColumnRenamed("supplier_id", "id"))
        found = _rings_of(nodes.join(latest, "id", "left").select("id", F.coalesce("_up", "parent_id").alias("parent")))
        if found is None:
            break
        rings, led = found
        out, seen = cut(rings.join(latest, "id").groupBy("ring_root").agg(F.max_by("id", "request_id").alias("id"), F.max("request_id").alias("request_id")), rows=F.count(F.lit(1)))
        if not seen["rows"]:
            break
        told = out.select("request_id")
        refused = told if refused is None else refused.unionByName(told)
        live = put.join(refused, "request_id", "left_anti")
        earlier = live.join(out.select(F.col("id").alias("supplier_id")), "supplier_id", "left_semi").groupBy(F.col("supplier_id").alias("id")).agg(F.max_by("parent_id", "request_id").alias("_up"))
        fallen, _ = cut(out.join(nodes, "id").join(earlier, "id", "left").select("ring_root", F.coalesce("_up", "parent_id").alias("_back")))
        led, _ = cut(led)
        closing = _closing(fallen, led)
        if closing is None:
            break
        nodes, _ = cut(nodes.join(led.join(closing, "ring_root", "left_semi").select("id"), "id", "left_semi"))
        live = live.join(nodes.select(F.col("id").alias("supplier_id")), "supplier_id", "left_semi")
    told = checked if refused is None else checked.join(refused.withColumn("_refused", F.lit(True)), "request_id", "left")
    verdict = F.coalesce("verdict", F.lit("ok")) if refused is None else F.coalesce("verdict", F.when(F.col("_refused"), "cycle"), F.lit("ok"))
    return told.select("request_id", "supplier_id", "parent_id", verdict.alias("verdict"))
