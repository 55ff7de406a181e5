"""Streets that several routes share: runs of colocated shape points, corridors, their slip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetline.functions import geo
from fleetline.sources.scratch import keep


def shape_bearings(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points of each (route, direction)'s most used shape, in order, with bearing to the next
    (the last point repeats the one before)."""
    from fleetline.operators.schedule import representative_shape

    chosen = representative_shape(trips, by_direction=True).select("route_id", "direction_id", "shape_id")
    pts = chosen.join(shapes, "shape_id").select("route_id", "direction_id", F.col("shape_pt_sequence").alias("seq"), F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon"))
    w = Window.partitionBy("route_id", "direction_id").orderBy("seq")
    own = geo.bearing_deg(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    pts = pts.withColumn("own", own)
    return pts.withColumn("bearing", F.coalesce("own", F.lag("own").over(w))).drop("own")


def corridor_runs(trips: DataFrame, shapes: DataFrame, *, prox_m: float = 15.0, bearing_deg: float = 30.0, min_points: int = 5) -> DataFrame:
    """Maximal runs of points with one constant set of colocated routes (two at least).

    Points meet by grid cell (each looks at its 3 x 3 cells, as wide as the shapes' latitude
    asks); then the distance and the bearing decide.  Runs come from gaps and islands over the ordered points.
    """
    dy = prox_m / geo.DEGREE_M
    limits = F.broadcast(shapes.agg(F.max(F.abs("shape_pt_lat")).alias("top")))  # one row
    dx = geo.cell_width(F.col("top"), prox_m)
    pts = shape_bearings(trips, shapes).crossJoin(limits).withColumns({"cy": geo.grid_cell(F.col("lat"), dy), "cx": geo.grid_cell(F.col("lon"), dx)})
    look = pts.select("route_id", "direction_id", "seq", "lat", "lon", "bearing", F.explode(geo.neighbour_cells(F.col("lat"), F.col("lon"), dy, dx)).alias("c")).select("*", "c.cy", "c.cx").drop("c")
    other = pts.select(F.col("route_id").alias("o_route"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("bearing").alias("o_bearing"), "cy", "cx")
    near = (geo.haversine_m(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) < prox_m) & (geo.bearing_distance(F.col("bearing"), F.col("o_bearing")) < bearing_deg)
    sets = look.join(other, ["cy", "cx"]).filter(near).groupBy("route_id", "direction_id", "seq", "lat", "lon", "bearing").agg(F.array_join(F.array_sort(F.collect_set("o_route")), ",").alias("routes"))
    w = Window.partitionBy("route_id", "direction_id").orderBy("seq")
    sets = sets.withColumn("new", F.coalesce((F.col("routes") != F.lag("routes").over(w)).cast("int"), F.lit(1)))
    sets = sets.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("route_id", "direction_id", "island").orderBy("seq")
    step = geo.haversine_m(F.lag("lat").over(inner), F.lag("lon").over(inner), F.col("lat"), F.col("lon"))
    runs = sets.withColumn("step", step).groupBy("route_id", "direction_id", "island", "routes").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length_m"), F.avg("bearing").alias("mean_bearing"),
        F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("points"),
    )
    return runs.filter((F.size(F.split("routes", ",")) >= 2) & (F.col("n_points") >= min_points)).withColumn("cardinal", geo.cardinal8(F.col("mean_bearing"))).drop("island")


def corridors(runs: DataFrame, route_stops: DataFrame, sequence: DataFrame, *, min_len_m: float = 500.0, snap_m: float = 100.0) -> DataFrame:
    """Corridors of long enough runs: ends snapped to the nearest shared stop, one per identity,
    contiguous ones merged, nested ones dropped.

    Identity is (routes, cardinal, end stops); the longest run of it stays.  Chains start at
    stops where no other corridor ends; a corridor that no chain takes up (a side branch, a
    cycle) stays as it is.  One whose stop ranges lie within a longer one's on every route,
    strictly on one, goes.  ``sequence``: route_id, direction_id, stop_id, stop_sequence.
    """
    long_ = runs.filter(F.col("length_m") >= min_len_m).withColumn("run", F.struct("route_id", "direction_id", "from_seq"))
    a, b = F.element_at("points", 1), F.element_at("points", -1)
    ends = long_.select("run", "routes", F.explode(F.array(F.struct(F.lit("start").alias("end"), a["lat"].alias("lat"), a["lon"].alias("lon")), F.struct(F.lit("end").alias("end"), b["lat"].alias("lat"), b["lon"].alias("lon")))).alias("e")).select("run", "routes", "e.*")
    dy = snap_m / geo.DEGREE_M
    limits = F.broadcast(route_stops.agg(F.max(F.abs("stop_lat")).alias("top")))  # one row: how wide cells must be at the stops' latitude
    dx = geo.cell_width(F.col("top"), snap_m)
    ends = ends.crossJoin(limits).select("*", F.explode(geo.neighbour_cells(F.col("lat"), F.col("lon"), dy, dx)).alias("c")).select("run", "routes", "end", "lat", "lon", "c.cy", "c.cx")
    places = route_stops.groupBy("stop_id", "stop_lat", "stop_lon").agg(F.array_sort(F.collect_set("route_id")).alias("serves")).crossJoin(limits).withColumns({"cy": geo.grid_cell(F.col("stop_lat"), dy), "cx": geo.grid_cell(F.col("stop_lon"), dx)}).drop("top")
    shared = F.size(F.array_intersect(F.split("routes", ","), "serves")) >= 2
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("stop_lat"), F.col("stop_lon"))
    snapped = ends.join(places, ["cy", "cx"]).filter(shared & (d < snap_m)).groupBy("run").pivot("end", ["start", "end"]).agg(F.min_by("stop_id", F.struct(d, F.col("stop_id"))))
    out = long_.join(snapped, "run").filter(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") != F.col("end")))
    nth = F.row_number().over(Window.partitionBy("routes", "cardinal", "start", "end").orderBy(F.desc("length_m"), "route_id", "direction_id", "from_seq"))
    out = out.withColumn("nth", nth).filter("nth = 1").select("routes", "cardinal", F.col("start").alias("start_stop"), F.col("end").alias("end_stop"), "length_m", geo.wkt_linestring(F.col("points")).alias("wkt"))
    out = out.withColumn("corridor_id", F.concat_ws("|", "cardinal", "routes", "start_stop", "end_stop"))
    spans = corridor_membership(out, sequence)
    spans = spans.groupBy("corridor_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("route_id", "direction_id").alias("on"), F.struct(F.col("start_seq").alias("a"), F.col("end_seq").alias("b"))))).alias("spans"))
    out = drop_nested(merge_chains(out.join(spans, "corridor_id", "left").drop("corridor_id")))
    return out.withColumn("corridor_id", F.sha2(F.concat_ws("|", "cardinal", "routes", "start_stop", "end_stop"), 256)).withColumn("display_name", F.concat_ws(" ", F.concat_ws("-", "start_stop", "end_stop"), "cardinal"))


_GROUP = ["cardinal", "routes"]


def merge_chains(corridors_: DataFrame) -> DataFrame:
    """Corridors of one (cardinal, routes) that follow each other end to start, as one each; adds rank.

    A corridor is followed by the longest one that starts where it ends.  Chains start at corridors that
    follow none; where chains run together the one with the first start (the longest corridor) goes on.
    Found by pointer jumping: after round k a corridor knows the best start within 2^k steps before it and the
    corridor 2^k steps ahead, so a chain of n takes log n rounds, each a join by corridor.
    """
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("length_m"), "start_stop", "end_stop")
    rows = keep(corridors_.withColumn("at", F.row_number().over(order)), "corridor-rows")
    following = rows.groupBy(*_GROUP, F.col("start_stop").alias("end_stop")).agg(F.min("at").alias("next"))
    ended = rows.select(*_GROUP, F.col("end_stop").alias("start_stop")).distinct().withColumn("follows", F.lit(True))
    own = rows.select(*_GROUP, "at", "start_stop", "end_stop").join(following, [*_GROUP, "end_stop"], "left").join(ended, [*_GROUP, "start_stop"], "left")
    links = own.select(*_GROUP, "at", "next", F.when(F.col("follows").isNull(), F.struct(F.col("at").alias("head"), F.lit(0).cast("long").alias("steps"))).alias("best"))
    longest = rows.agg(F.max("at")).first()[0] or 0  # corridors of the largest group
    links, reach = keep(links, "corridor-links"), 1
    while reach < longest:
        ahead = links.filter("next IS NOT NULL AND best IS NOT NULL").select(*_GROUP, F.col("next").alias("at"), F.struct(F.col("best.head").alias("head"), (F.col("best.steps") + reach).alias("steps")).alias("found"))
        ahead = ahead.groupBy(*_GROUP, "at").agg(F.min("found").alias("found"))
        jump = links.select(*_GROUP, F.col("at").alias("next"), F.col("next").alias("beyond"))
        links = links.join(jump, [*_GROUP, "next"], "left").join(ahead, [*_GROUP, "at"], "left").select(*_GROUP, "at", F.col("beyond").alias("next"), F.least("best", "found").alias("best"))
        links, reach = keep(links, "corridor-links"), reach * 2
    chained = rows.join(links.select(*_GROUP, "at", "best"), [*_GROUP, "at"]).withColumn("head", F.coalesce("best.head", F.col("at"))).withColumn("loose", F.col("best").isNull())
    parts = chained.groupBy(*_GROUP, "loose", "head").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("best.steps", F.lit(0)).alias("steps"), "at"))).alias("order"), F.sum("length_m").alias("length_m"),
                                                         F.min_by("start_stop", F.coalesce("best.steps", F.lit(0))).alias("start_stop"), F.max_by("end_stop", F.coalesce("best.steps", F.lit(0))).alias("end_stop"),
                                                         F.min_by("spans", F.coalesce("best.steps", F.lit(0))).alias("first"), F.max_by("spans", F.coalesce("best.steps", F.lit(0))).alias("last"),
                                                         F.array_sort(F.collect_list(F.struct(F.coalesce("best.steps", F.lit(0)).alias("steps"), "wkt"))).alias("lines"))
    inside = F.transform("lines", lambda x: F.regexp_extract(x["wkt"], r"^LINESTRING\((.*)\)$", 1))
    both = F.filter(F.map_keys("first"), lambda k: F.map_contains_key("last", k))
    spans = F.transform(both, lambda k: F.struct(k.alias("on"), F.element_at("first", k)["a"].alias("a"), F.element_at("last", k)["b"].alias("b")))
    rank = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.desc("length_m"), "loose", "head"))
    return parts.select("routes", "cardinal", "start_stop", "end_stop", "length_m", F.concat(F.lit("LINESTRING("), F.array_join(inside, ", "), F.lit(")")).alias("wkt"), F.coalesce(spans, F.array()).alias("spans"), "loose", "head").withColumn("rank", rank).drop("loose", "head")


def drop_nested(merged: DataFrame) -> DataFrame:
    """Corridors without those that lie within an earlier one (of lower rank: longer) of their (cardinal, routes).

    An interval join per route and direction; being nested is transitive, so it is enough that any earlier
    corridor holds one.
    """
    ranges = merged.select(*_GROUP, "rank", F.size("spans").alias("n"), F.explode("spans").alias("s")).select(*_GROUP, "rank", "n", "s.on", "s.a", "s.b")
    outer = ranges.select(*_GROUP, "on", "n", F.col("rank").alias("o_rank"), F.col("a").alias("o_a"), F.col("b").alias("o_b"))
    held = ranges.join(outer, [*_GROUP, "on", "n"]).filter((F.col("o_rank") < F.col("rank")) & (F.col("o_a") <= F.col("a")) & (F.col("b") <= F.col("o_b")))
    strict = (F.col("o_a") < F.col("a")) | (F.col("b") < F.col("o_b"))
    gone = held.groupBy(*_GROUP, "rank", "o_rank").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max(strict).alias("strict")).filter("k = n AND strict")
    return merged.join(gone.select(*_GROUP, "rank").distinct(), [*_GROUP, "rank"], "left_anti").select("routes", "cardinal", "start_stop", "end_stop", "length_m", "wkt")


def corridor_membership(corridors_: DataFrame, sequence: DataFrame) -> DataFrame:
    """(corridor_id, route, direction, start_seq, end_seq): member routes whose canonical sequence
    visits both ends; swapped where it visits them the other way round."""
    members = corridors_.select("corridor_id", "start_stop", "end_stop", F.explode(F.split("routes", ",")).alias("route_id"))
    at = lambda c, name: sequence.groupBy("route_id", "direction_id", F.col("stop_id").alias(c)).agg(F.min("stop_sequence").alias(name))
    out = members.join(at("start_stop", "a"), ["route_id", "start_stop"]).join(at("end_stop", "b"), ["route_id", "direction_id", "end_stop"])
    return out.select("corridor_id", "route_id", "direction_id", F.least("a", "b").alias("start_seq"), F.greatest("a", "b").alias("end_seq"))


def corridor_slip(membership: DataFrame, segments: DataFrame) -> DataFrame:
    """(corridor, period): slip of the segments inside each member's span; an equi join on route and direction with the range as residual."""
    inside = membership.join(segments, ["route_id", "direction_id"]).filter((F.col("from_seq") >= F.col("start_seq")) & (F.col("to_seq") <= F.col("end_seq")))
    n, slip = F.col("n_obs"), F.col("mean_slip_sec")
    out = inside.groupBy("corridor_id", "period").agg(
        F.sum(n * slip).alias("weighted_slip"), F.sum("n_obs").alias("n_obs"), (F.sum(n * slip) / F.sum(n)).alias("mean_slip_sec"), F.count_distinct("route_id", "direction_id").alias("n_route_dirs")
    )
    peak = out.filter("period <> 'all'").groupBy("corridor_id").agg(F.max_by("period", F.struct("mean_slip_sec", "period")).alias("peak"))
    return out.join(peak, "corridor_id", "left").withColumn("peak_period", F.when(F.col("period") == "all", F.col("peak"))).drop("peak")


def rank_corridors(slip: DataFrame, *, period: str = "all", k: int = 20) -> DataFrame:
    return slip.filter(F.col("period") == period).orderBy(F.desc("weighted_slip"), "corridor_id").limit(k)


def corridor_segments(membership: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments of each corridor, with contributing routes."""
    inside = membership.join(segments, ["route_id", "direction_id"]).filter((F.col("from_seq") >= F.col("start_seq")) & (F.col("to_seq") <= F.col("end_seq")))
    out = inside.groupBy("corridor_id", "period", "from_stop", "to_stop").agg(F.sum("n_obs").alias("n_obs"), (F.sum(F.col("n_obs") * F.col("mean_slip_sec")) / F.sum("n_obs")).alias("mean_slip_sec"), F.array_join(F.array_sort(F.collect_set("route_id")), ",").alias("routes"))
    return out
