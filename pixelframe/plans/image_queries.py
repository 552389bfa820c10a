"""Queries of pixel, mask and region operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.operators import mask as M
from pixelframe.operators import pixels as P
from pixelframe.operators import regions as R
from pixelframe.plans import segmentation as G
from pixelframe.plans.registry import query
from pixelframe.plans.scalar_queries import HSV_SQL
from pixelframe.sources import files as files_
from pixelframe.sources import tables as T

MIN_ESD = 2.0  # frames are small
GRAY = "((r * 9798 + g * 19235 + b * 3735 + 16384) >> 15)"


def fg(spark: SparkSession, d: str, most: int = 85) -> DataFrame:
    """Foreground of the single-channel frames: values of at most 85."""
    return T.px(spark, d).filter(F.col("v") <= most).drop("v").withColumns({"h": F.lit(T.SIDE), "w": F.lit(T.SIDE)})


def spots(mask: DataFrame) -> DataFrame:
    return mask.select("dataset_id", "image_id", "seq", "y", "x")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return R.label_regions(M.mask_runs(fg(spark, d)))


def _numbered(spark: SparkSession, d: str, found: DataFrame) -> DataFrame:
    """What was read from image files (path: dataset_id/seq.jpg), with the ids of the images written there."""
    part = lambda k: F.regexp_extract("path", "(\\d+)/(\\d+)[.]jpg$", k).cast("long")
    ids = T.frames(spark, d).select("dataset_id", F.col("seq").alias("place"), "image_id", F.size("v").cast("long").alias("n"))
    return found.withColumns({"dataset_id": part(1), "place": part(2)}).join(ids, ["dataset_id", "place"])


@query("scan_images", "SELECT label::BIGINT AS dataset_id, vec_id AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, len(embedding) AS n FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "images")
    files_.write_images(T.scanlines(spark, d), to)
    return _numbered(spark, d, files_.scan_images(spark, f"{to}/*")).select("dataset_id", "image_id", F.col("seq").cast("long").alias("seq"), "n")


@query("decode_scanlines", "SELECT image_id, y, string_agg(b::VARCHAR, ',' ORDER BY x) AS b, string_agg(g::VARCHAR, ',' ORDER BY x) AS g, string_agg(r::VARCHAR, ',' ORDER BY x) AS r FROM bgr GROUP BY image_id, y", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "images")
    files_.write_images(T.scanlines(spark, d), to)
    return _numbered(spark, d, files_.decoded(spark, f"{to}/*")).select("image_id", "y", *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in "bgr"])


@query("scan_image_files", "SELECT CAST(label AS BIGINT) AS dataset_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "images")
    files_.write_images(T.scanlines(spark, d), to)
    return files_.scan_images(spark, f"{to}/*").select(F.regexp_extract("path", "(\\d+)/[^/]*$", 1).cast("long").alias("dataset_id"), F.col("seq").cast("long").alias("seq"))


@query("decode_image_files", "SELECT dataset_id, seq, y, max(w) AS w, max(h) AS h, string_agg(b::VARCHAR, ',' ORDER BY x) AS b, string_agg(g::VARCHAR, ',' ORDER BY x) AS g, string_agg(r::VARCHAR, ',' ORDER BY x) AS r FROM (SELECT *, 8 AS w, 8 AS h FROM bgr) GROUP BY dataset_id, seq, y", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "images")
    files_.write_images(T.scanlines(spark, d), to)
    part = lambda k: F.regexp_extract("path", "(\\d+)/(\\d+)[.]jpg$", k).cast("long")
    lines = files_.decoded(spark, f"{to}/*")
    return lines.select(part(1).alias("dataset_id"), part(2).alias("seq"), "y", "w", "h", *[F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c) for c in "bgr"])


_FLAT = """k AS (SELECT dataset_id, CASE WHEN least(n, 10) % 2 = 0 THEN least(n, 10) - 1 ELSE least(n, 10) END AS k FROM (SELECT dataset_id, count(DISTINCT image_id) AS n FROM bgr GROUP BY 1)),
flat AS (SELECT dataset_id, y, x, list_sort(list(b))[count(*) // 2 + 1] AS b, list_sort(list(g))[count(*) // 2 + 1] AS g, list_sort(list(r))[count(*) // 2 + 1] AS r FROM bgr JOIN k USING (dataset_id) WHERE seq < k GROUP BY dataset_id, y, x)"""


def _flat(spark: SparkSession, d: str) -> DataFrame:
    lines = T.scanlines(spark, d)
    return P.median_flat(lines.join(P.background_images(P.images(lines)).select("image_id"), "image_id"))


@query("median_flat", f"WITH {_FLAT} SELECT * FROM flat", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.exploded(_flat(spark, d))


@query("take_first_n_images", f"WITH {_FLAT} SELECT dataset_id, image_id, seq FROM bgr JOIN k USING (dataset_id) WHERE seq < k AND y = 0 AND x = 0", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.background_images(P.images(T.scanlines(spark, d)))


def _ratio(c: str) -> str:
    return f"CASE WHEN p.y = 0 AND p.x = 0 THEN 0 WHEN f.{c} = 0 THEN CASE WHEN p.{c} > 0 THEN 255 ELSE 0 END ELSE CAST(floor(least(greatest(p.{c} / f.{c}, 0), 1.04::DOUBLE) / 1.04::DOUBLE * 255) AS INT) END AS {c}"


_CORRECTED = f"{_FLAT}, corrected AS (SELECT p.dataset_id, p.image_id, p.seq, p.y, p.x, {_ratio('b')}, {_ratio('g')}, {_ratio('r')} FROM bgr p JOIN flat f USING (dataset_id, y, x))"


def _corrected(spark: SparkSession, d: str) -> DataFrame:
    return P.flat_correct(T.scanlines(spark, d), _flat(spark, d))


@query("flat_correct", f"WITH {_CORRECTED} SELECT * FROM corrected", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.exploded(_corrected(spark, d))


@query("to_gray", f"SELECT image_id, y, x, {GRAY} AS gray FROM bgr", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return T.exploded(P.gray_lines(T.scanlines(spark, d)), ("gray",)).select("image_id", "y", "x", "gray")


_HIST = f"{_CORRECTED}, gray AS (SELECT *, {GRAY} AS gray FROM corrected), hist AS (SELECT i.image_id, v.g, count(c.gray) AS n FROM (SELECT DISTINCT image_id FROM gray) i CROSS JOIN range(256) v(g) LEFT JOIN gray c ON c.image_id = i.image_id AND c.gray = v.g GROUP BY 1, 2)"


def _gray(spark: SparkSession, d: str) -> DataFrame:
    return P.gray_lines(_corrected(spark, d))


@query("gray_histogram", f"WITH {_HIST} SELECT image_id, g, n FROM hist", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.gray_histogram(_gray(spark, d)).select("image_id", F.posexplode("hist").alias("g", "n")).select("image_id", F.col("g").cast("long").alias("g"), "n")


_TRIANGLE = f"""{_HIST}, ends AS (SELECT image_id, min(g) FILTER (n > 0) AS lo0, max(g) FILTER (n > 0) AS hi0, max(n) AS top FROM hist GROUP BY 1),
peak AS (SELECT e.image_id, CASE WHEN lo0 > 0 THEN lo0 - 1 ELSE 0 END AS lo, CASE WHEN hi0 < 255 THEN hi0 + 1 ELSE 255 END AS hi, min(g) AS p FROM ends e JOIN hist h ON h.image_id = e.image_id AND h.n = top GROUP BY ALL),
side AS (SELECT image_id, p - lo < hi - p AS flip, CASE WHEN p - lo < hi - p THEN 255 - hi ELSE lo END AS lo, CASE WHEN p - lo < hi - p THEN 255 - p ELSE p END AS p FROM peak),
turned AS (SELECT s.image_id, s.flip, s.lo, s.p, CASE WHEN s.flip THEN 255 - g ELSE g END AS i, n FROM side s JOIN hist USING (image_id)),
scored AS (SELECT t.image_id, t.i, a.n * t.i + (t.lo - t.p) * t.n AS v FROM turned t JOIN turned a ON a.image_id = t.image_id AND a.i = t.p WHERE t.i > t.lo AND t.i <= t.p),
best AS (SELECT image_id, arg_max(i, struct_pack(v := v, i := -i)) AS i FROM scored WHERE v > 0 GROUP BY 1),
triangle AS (SELECT image_id, CAST(CASE WHEN flip THEN 255 - (coalesce(i, lo) - 1) ELSE coalesce(i, lo) - 1 END AS INT) AS threshold FROM side LEFT JOIN best USING (image_id))"""


@query("triangle_threshold", f"WITH {_TRIANGLE} SELECT * FROM triangle", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.triangle_threshold(P.gray_histogram(_gray(spark, d)))


@query("simple_threshold", f"WITH {_TRIANGLE} SELECT image_id, y, x FROM gray JOIN triangle USING (image_id) WHERE gray <= threshold", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = _gray(spark, d)
    return P.below_threshold(lines, P.triangle_threshold(P.gray_histogram(lines))).select("image_id", "y", "x")


_ADAPTIVE = f"""WITH gray AS (SELECT image_id, y, x, {GRAY} AS gray FROM bgr), o AS (SELECT unnest(range(-9, 10)) AS d),
rowsum AS (SELECT g.image_id, g.y, g.x, sum(n.gray) AS s FROM gray g CROSS JOIN o JOIN gray n ON n.image_id = g.image_id AND n.y = g.y AND n.x = least(greatest(g.x + d, 0), 7) GROUP BY ALL),
total AS (SELECT g.image_id, g.y, g.x, sum(n.s) AS s FROM rowsum g CROSS JOIN o JOIN rowsum n ON n.image_id = g.image_id AND n.x = g.x AND n.y = least(greatest(g.y + d, 0), 7) GROUP BY ALL)"""


@query("adaptive_threshold", f"{_ADAPTIVE} SELECT image_id, y, x FROM gray JOIN total USING (image_id, y, x) WHERE gray * 361 <= s - 4 * 361", ("bgr",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.adaptive_threshold(P.gray_lines(T.scanlines(spark, d))).select("image_id", "y", "x")


def _values(kernel: list[tuple[int, int]]) -> str:
    return ", ".join(f"({dy}, {dx})" for dy, dx in kernel)


def _erosion(source: str, kernel: str, name: str) -> str:
    reach = f"(SELECT count(*) FROM {kernel} o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"
    moved = f"SELECT dataset_id, image_id, seq, CAST(y - dy AS INT) AS y, CAST(x - dx AS INT) AS x, count(*) AS n FROM {source} CROSS JOIN {kernel} WHERE y - dy BETWEEN 0 AND 7 AND x - dx BETWEEN 0 AND 7 GROUP BY ALL"
    return f"{name} AS (SELECT dataset_id, image_id, seq, y, x FROM ({moved}) m WHERE n = {reach})"


def _dilation(source: str, kernel: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT dataset_id, image_id, seq, CAST(y - dy AS INT) AS y, CAST(x - dx AS INT) AS x FROM {source} CROSS JOIN {kernel} WHERE y - dy BETWEEN 0 AND 7 AND x - dx BETWEEN 0 AND 7)"


_KERNELS = f"sq(dy, dx) AS (VALUES {_values(M.SQUARE)}), el(dy, dx) AS (VALUES {_values(M.ELLIPSE)}), around(dy, dx) AS (VALUES {_values(M.AROUND)})"
_PREVIOUS = "subtracted AS (SELECT m.* FROM fg m ANTI JOIN (SELECT dataset_id, seq + 1 AS seq, y, x FROM fg) p USING (dataset_id, seq, y, x))"


@query("erode", f"WITH {_KERNELS}, {_erosion('fg', 'sq', 'out')} SELECT * FROM out", ("fg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return spots(M.erode(fg(spark, d)))


@query("dilate", f"WITH {_KERNELS}, {_dilation('fg', 'el', 'out')} SELECT * FROM out", ("fg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return spots(M.dilate(fg(spark, d)))


@query("close", f"WITH {_KERNELS}, {_dilation('fg', 'el', 'wide')}, {_erosion('wide', 'el', 'out')} SELECT * FROM out", ("fg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return spots(M.close(fg(spark, d)))


@query("erode2", f"WITH {_KERNELS}, wide AS (SELECT dataset_id, image_id, seq, y, x FROM px WHERE v <= 200), {_erosion('wide', 'el', 'out')} SELECT * FROM out", ("px",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return spots(M.mask_pipeline(fg(spark, d, 200), ["erode2"]))


@query("no_op", "SELECT * FROM fg", ("fg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return spots(M.no_op(fg(spark, d)))


@query("remove_previous_mask", f"WITH {_PREVIOUS} SELECT * FROM subtracted", ("fg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return spots(M.remove_previous_mask(fg(spark, d)))


@query("previous_mask_lag", "SELECT image_id, y, x, lag(v <= 85) OVER (PARTITION BY dataset_id, y, x ORDER BY seq) AS before FROM px", ("px",))
def _(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("dataset_id", "y", "x").orderBy("seq")
    return T.px(spark, d).select("image_id", "y", "x", F.lag(F.col("v") <= 85).over(order).alias("before"))


@query("mask_pipeline", f"WITH {_KERNELS}, {_PREVIOUS}, {_erosion('subtracted', 'sq', 's1')}, {_dilation('s1', 'el', 's2')}, {_dilation('s2', 'el', 's3')}, {_erosion('s3', 'el', 's4')}, {_erosion('s4', 'el', 's5')} SELECT * FROM s5", ("fg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return spots(M.mask_pipeline(fg(spark, d), M.pipeline_names(subtract_previous=True)))


@query("write_stage_snapshots", f"WITH {_KERNELS}, {_erosion('fg', 'sq', 's1')}, {_dilation('s1', 'el', 's2')} SELECT 0 AS k, 'no_op' AS stage, count(*) AS n FROM fg UNION ALL SELECT 1, 'erode', count(*) FROM s1 UNION ALL SELECT 2, 'dilate', count(*) FROM s2", ("fg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    to = files_.scratch(spark, "snapshots")
    files_.write_stage_snapshots(fg(spark, d), ["no_op", "erode", "dilate"], to)
    return spark.read.parquet(to).groupBy("k", "stage").agg(F.count("*").alias("n"))


@query("neighbour_join", f"WITH {_KERNELS} SELECT f.image_id, f.y, f.x, count(*) AS n FROM fg f CROSS JOIN around JOIN fg q ON q.image_id = f.image_id AND q.y = f.y + dy AND q.x = f.x + dx GROUP BY ALL", ("fg",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.neighbour_counts(fg(spark, d)).select("image_id", "y", "x", "n")


@query("mask_runs", "SELECT * FROM runs", ("runs",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.mask_runs(fg(spark, d)).drop("h", "w")


@query("run_adjacency", "SELECT a.image_id, a.y AS y_a, a.x0 AS a0, a.x1 AS a1, b.y AS y_b, b.x0 AS b0, b.x1 AS b1 FROM runs a JOIN runs b ON a.image_id = b.image_id AND a.y + 1 = b.y AND a.x0 <= b.x1 + 1 AND a.x1 >= b.x0 - 1", ("runs",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return M.run_adjacency(M.mask_runs(fg(spark, d)))


@query("label_regions", "SELECT image_id, y, x, label FROM regions", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.region_pixels(labelled(spark, d)).select("image_id", "y", "x", "label")


_GEOMETRY = """geometry AS (SELECT image_id, label, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x * x)::BIGINT AS sxx, sum(y * y)::BIGINT AS syy, sum(x * y)::BIGINT AS sxy, min(x) AS bx, min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM regions GROUP BY image_id, label)"""


@query(
    "region_geometry",
    f"WITH {_GEOMETRY} SELECT image_id, label, bx, top AS \"by\", width, height, n AS area_exc, round(sx / n, 6) AS x, round(sy / n, 6) AS y, round(sx / n - bx, 6) AS local_centroid_col, round(sy / n - top, 6) AS local_centroid_row, (width * height)::BIGINT AS bounding_box_area, round(n / (width * height), 6) AS extent, round(sqrt(4 * n / pi()), 6) AS equivalent_diameter FROM geometry",
    ("regions",),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    g = R.region_geometry(labelled(spark, d))
    return g.select("image_id", "label", "bx", "by", "width", "height", "area_exc", *[F.round(c, 6).alias(c) for c in ("x", "y", "local_centroid_col", "local_centroid_row", "extent", "equivalent_diameter")], "bounding_box_area")


_MOMENTS = f"""{_GEOMETRY}, central AS (SELECT *, (n * sxx - sx * sx) / (n * n) AS mxx, (n * syy - sy * sy) / (n * n) AS myy, (n * sxy - sx * sy) / (n * n) AS mxy FROM geometry),
spread AS (SELECT *, greatest((mxx + myy) / 2 + sqrt(((mxx - myy) / 2) * ((mxx - myy) / 2) + mxy * mxy), 0) AS l1, greatest((mxx + myy) / 2 - sqrt(((mxx - myy) / 2) * ((mxx - myy) / 2) + mxy * mxy), 0) AS l2 FROM central),
moments AS (SELECT image_id, label, 4 * sqrt(l1) AS major, 4 * sqrt(l2) AS minor, CASE WHEN l1 = 0 THEN 0 ELSE sqrt(1 - l2 / l1) END AS eccentricity, CASE WHEN mxx = myy THEN CASE WHEN -mxy < 0 THEN pi() / 4 ELSE -pi() / 4 END ELSE 0.5 * atan2(2 * mxy + 0.0, myy - mxx) END / pi() * 180 + 90 AS angle, 4 * sqrt(l1) / nullif(4 * sqrt(l2), 0) AS elongation FROM spread)"""


@query("region_moments", f"WITH {_MOMENTS} SELECT image_id, label, round(major, 5) AS major, round(minor, 5) AS minor, round(eccentricity, 5) AS eccentricity, round(angle, 5) AS angle, round(CASE WHEN minor > 0.001 THEN elongation END, 5) AS elongation FROM moments", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = R.region_moments(R.region_geometry(labelled(spark, d))).withColumn("elongation", F.when(F.col("minor") > 0.001, F.col("elongation")))
    return m.select("image_id", "label", *[F.round(c, 5).alias(c) for c in ("major", "minor", "eccentricity", "angle", "elongation")])


_PERIMETER = f"""border AS (SELECT r.* FROM regions r WHERE (SELECT count(*) FROM regions q WHERE q.image_id = r.image_id AND q.label = r.label AND abs(q.y - r.y) + abs(q.x - r.x) = 1) < 4),
code AS (SELECT b.image_id, b.label, b.y, b.x, 1 + 2 * count(*) FILTER (abs(q.y - b.y) + abs(q.x - b.x) = 1) + 10 * count(*) FILTER (abs(q.y - b.y) = 1 AND abs(q.x - b.x) = 1) AS c FROM border b JOIN border q ON q.image_id = b.image_id AND q.label = b.label AND abs(q.y - b.y) <= 1 AND abs(q.x - b.x) <= 1 GROUP BY ALL),
perimeter AS (SELECT image_id, label, count(*) FILTER (c IN (5, 7, 15, 17, 25, 27)) + count(*) FILTER (c IN (21, 33)) * sqrt(2) + count(*) FILTER (c IN (13, 23)) * (1 + sqrt(2)) / 2 AS perim FROM code GROUP BY 1, 2)"""


@query("region_perimeter", f"WITH {_PERIMETER} SELECT image_id, label, round(perim, 6) AS perim FROM perimeter", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.region_perimeter(labelled(spark, d)).select("image_id", "label", F.round("perim", 6).alias("perim"))


# background of each region's box with a margin of one; what the corner reaches by 8-connected steps is outside
_HOLES = f"""{_GEOMETRY}, cells AS MATERIALIZED (SELECT g.image_id, g.label, ys.v AS y, xs.v AS x, ys.v = top - 1 AND xs.v = bx - 1 AS corner FROM geometry g, range(-1, 10) ys(v), range(-1, 10) xs(v) WHERE ys.v BETWEEN top - 1 AND top + height AND xs.v BETWEEN bx - 1 AND bx + width AND NOT EXISTS (SELECT 1 FROM regions r WHERE r.image_id = g.image_id AND r.label = g.label AND r.y = ys.v AND r.x = xs.v)),
outside AS (SELECT image_id, label, y, x FROM cells WHERE corner UNION SELECT c.image_id, c.label, c.y, c.x FROM outside o JOIN cells c ON c.image_id = o.image_id AND c.label = o.label AND abs(c.y - o.y) <= 1 AND abs(c.x - o.x) <= 1),
holes AS (SELECT image_id, label, y, x FROM cells EXCEPT SELECT * FROM outside)"""


@query("region_filled_area", f"WITH {_HOLES} SELECT image_id, label, n + coalesce(h, 0) AS area, round(1 - n / (n + coalesce(h, 0)), 6) AS pct_area FROM geometry LEFT JOIN (SELECT image_id, label, count(*) AS h FROM holes GROUP BY 1, 2) USING (image_id, label)", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = labelled(spark, d)
    g = R.region_geometry(runs)
    area = R.region_filled_area(g, R.region_holes(runs, g))
    return area.join(g.select("image_id", "label", "n"), R.REGION).select("image_id", "label", "area", F.round(1 - F.col("n") / F.col("area"), 6).alias("pct_area"))


_EULER = """corners(dy, dx, bit) AS (VALUES (0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8)), quads AS (SELECT image_id, label, y + dy AS y, x + dx AS x, sum(bit) AS q FROM regions CROSS JOIN corners GROUP BY ALL),
euler AS (SELECT image_id, label, CAST(sum(CASE WHEN q IN (1, 2, 4, 8) THEN 1 WHEN q IN (7, 11, 13, 14) THEN -1 WHEN q IN (6, 9) THEN -2 ELSE 0 END) / 4 AS INT) AS euler_number FROM quads GROUP BY 1, 2)"""


@query("region_euler", f"WITH {_EULER} SELECT * FROM euler", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.region_euler(labelled(spark, d))


# a pixel is in the hull if it is on the inner side of every line that can bound one of these small frames; the hull's
# corners are middles of pixels' edges, so all is counted in halves
_CONVEX = f"""{_GEOMETRY}, normals AS MATERIALIZED (SELECT a, b FROM range(-16, 17) u(a), range(-16, 17) v(b) WHERE gcd(abs(a), abs(b)) = 1),
support AS MATERIALIZED (SELECT image_id, label, a, b, 2 * max(a * y + b * x) + greatest(abs(a), abs(b)) AS s FROM regions, normals GROUP BY image_id, label, a, b),
boxes AS (SELECT image_id, label, ys.v AS y, xs.v AS x FROM geometry, range(0, 8) ys(v), range(0, 8) xs(v) WHERE ys.v BETWEEN top AND top + height - 1 AND xs.v BETWEEN bx AND bx + width - 1),
hull AS (SELECT image_id, label, y, x FROM boxes JOIN support USING (image_id, label) GROUP BY image_id, label, y, x HAVING bool_and(2 * (a * y + b * x) <= s)),
convex AS (SELECT image_id, label, count(*) AS convex_area FROM hull GROUP BY ALL)"""


@query("region_convex", f"WITH {_CONVEX} SELECT image_id, label, convex_area, round(n / convex_area, 6) AS solidity FROM geometry JOIN convex USING (image_id, label)", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = labelled(spark, d)
    g = R.region_geometry(runs).select("image_id", "label", "n")
    return R.region_convex(runs).join(g, R.REGION).select("image_id", "label", "convex_area", F.round(F.col("n") / F.col("convex_area"), 6).alias("solidity"))


_COLOUR = ", ".join(f"round(sum({c})::BIGINT / count(*), 6) AS Mean{n}, round(sqrt((count(*) * sum({c} * {c}) - sum({c}) * sum({c}))::DOUBLE) / count(*), 6) AS Std{n}" for c, n in (("h", "Hue"), ("s", "Saturation"), ("hsv.v", "Value")))


@query("region_colour", f"{HSV_SQL}, {_HOLES}, filled AS (SELECT image_id, label, y, x FROM regions UNION ALL SELECT image_id, label, y, x FROM holes) SELECT f.image_id, f.label, {_COLOUR} FROM filled f JOIN hsv USING (image_id, y, x) GROUP BY 1, 2", ("bgr", "regions"))
def _(spark: SparkSession, d: str) -> DataFrame:
    runs = labelled(spark, d)
    g = R.region_geometry(runs)
    filled = runs.select("image_id", "label", "y", "x0", "x1").unionByName(R.region_holes(runs, g))
    out = R.region_colour(filled, T.scanlines(spark, d))
    return out.select("image_id", "label", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


_BLUR = f"""{_GEOMETRY}, crop AS (SELECT g.image_id, g.label, y, x, {GRAY} AS c FROM geometry g JOIN bgr p ON p.image_id = g.image_id AND p.y BETWEEN top AND top + height - 1 AND p.x BETWEEN bx AND bx + width - 1),
sides AS (SELECT *, lag(c) OVER v AS u, lead(c) OVER v AS d, lag(c) OVER w AS l, lead(c) OVER w AS r FROM crop WINDOW v AS (PARTITION BY image_id, label, x ORDER BY y), w AS (PARTITION BY image_id, label, y ORDER BY x)),
lap AS (SELECT image_id, label, coalesce(u, d, c) + coalesce(d, u, c) + coalesce(l, r, c) + coalesce(r, l, c) - 4 * c AS l FROM sides)"""


@query("region_blur", f"WITH {_BLUR} SELECT image_id, label, round((count(*) * sum(l * l) - sum(l) * sum(l))::DOUBLE / (count(*) * count(*)), 6) AS blur_laplacian FROM lap GROUP BY 1, 2", ("bgr", "regions"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.region_blur(R.region_geometry(labelled(spark, d)), T.scanlines(spark, d)).select("image_id", "label", F.round("blur_laplacian", 6).alias("blur_laplacian"))


_KEPT = f"{_GEOMETRY}, kept AS (SELECT * FROM geometry WHERE sqrt(4 * n / pi()) >= {MIN_ESD})"


@query("filter_min_size_regions", f"WITH {_KEPT} SELECT image_id, label, n FROM kept", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_large(R.region_geometry(labelled(spark, d)), MIN_ESD).select("image_id", "label", "n")


@query("count_objects", f"WITH {_KEPT} SELECT g.image_id, count(*) AS regions, count(k.label) AS objects FROM geometry g LEFT JOIN kept k USING (image_id, label) GROUP BY 1", ("regions",))
def _(spark: SparkSession, d: str) -> DataFrame:
    g = R.region_geometry(labelled(spark, d))
    return g.groupBy("image_id").agg(F.count("*").alias("regions"), F.count_if(F.col("equivalent_diameter") >= MIN_ESD).alias("objects"))


@query(
    "object_index_images",
    f"WITH {_KEPT}, i AS (SELECT image_id, label, row_number() OVER (PARTITION BY image_id ORDER BY label) - 1 AS i FROM kept), c AS (SELECT dataset_id, image_id, seq, count(k.label) AS n FROM (SELECT DISTINCT dataset_id, image_id, seq FROM px) LEFT JOIN kept k USING (image_id) GROUP BY ALL), b AS (SELECT image_id, coalesce(sum(n) OVER (PARTITION BY dataset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c) SELECT image_id, image_id || '_' || i AS object_id, i + before AS object_label FROM i JOIN b USING (image_id)",
    ("regions",),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    kept = R.object_index(R.keep_large(R.region_geometry(labelled(spark, d)), MIN_ESD))
    images = P.images(T.scanlines(spark, d))
    counts = images.join(kept.groupBy("image_id").agg(F.count("*").alias("n")), "image_id", "left")
    earlier = Window.partitionBy("dataset_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("image_id", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(earlier), F.lit(0)).alias("before"))
    return kept.join(before, "image_id").select("image_id", F.concat_ws("_", F.col("image_id").cast("string"), F.col("i").cast("string")).alias("object_id"), (F.col("i") + F.col("before")).alias("object_label"))


@query("crop_objects", f"WITH {_KEPT} SELECT k.image_id, k.label, p.y, greatest(bx - 2, 0) AS x0, string_agg(g::VARCHAR, ',' ORDER BY x) AS g FROM kept k JOIN bgr p ON p.image_id = k.image_id AND p.y BETWEEN top - 2 AND top + height + 1 AND p.x BETWEEN bx - 2 AND bx + width + 1 GROUP BY k.image_id, k.label, p.y, bx", ("bgr", "regions"))
def _(spark: SparkSession, d: str) -> DataFrame:
    kept = R.keep_large(R.region_geometry(labelled(spark, d)), MIN_ESD)
    return R.crop_objects(kept, T.scanlines(spark, d), pad=2).select("image_id", "label", "y", "x0", F.array_join(F.transform("g", lambda v: v.cast("string")), ",").alias("g"))


@query("flat_window", "WITH c AS (SELECT label::BIGINT AS dataset_id, vec_id AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, count(*) OVER (PARTITION BY label) AS n FROM embeddings), f AS (SELECT *, CASE WHEN n = 10 THEN 0 WHEN seq > n - 11 THEN greatest(seq - 10, 0) ELSE seq END AS a, CASE WHEN n = 10 THEN 10 WHEN seq > n - 11 THEN seq ELSE seq + 10 END AS z FROM c) SELECT dataset_id, image_id, seq, a AS first_seq, CASE WHEN z - a = 10 THEN 9 ELSE z - a END AS used FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.flat_window(P.images(T.scanlines(spark, d)))


_COUNTS = "WITH c AS (SELECT o_custkey AS dataset_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate), w AS (SELECT *, sum(n) OVER b AS s, count(*) OVER b AS k FROM c WINDOW b AS (PARTITION BY dataset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), t AS (SELECT *, s / k AS cma, coalesce(s > 0 AND n * k > s + 1 * k, false) AS trigger FROM w)"


def _order_counts(spark: SparkSession, d: str) -> DataFrame:
    """Line items of each order, orders in a customer's sequence."""
    n = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = T.table(spark, d, "orders").join(n, "o_orderkey", "left")
    return orders.select(F.col("o_custkey").alias("dataset_id"), "o_orderkey", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.coalesce("n", F.lit(0)).alias("n"))


@query("cumulative_moving_average", f"{_COUNTS} SELECT dataset_id, o_orderkey, seq, n, round(cma, 6) AS cma, trigger FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.cumulative_trigger(_order_counts(spark, d), 1).withColumn("cma", F.round("cma", 6))


@query("flat_epochs", f"{_COUNTS} SELECT dataset_id, o_orderkey, seq, n, round(cma, 6) AS cma, trigger, coalesce(sum(trigger::BIGINT) OVER (PARTITION BY dataset_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.flat_epochs(_order_counts(spark, d), 1).withColumn("cma", F.round("cma", 6))


def rounded(measured: DataFrame) -> DataFrame:
    """Measurements to five places, as sums in another order differ in the last ones; no elongation of mere lines."""
    m = measured.withColumn("elongation", F.when(F.col("minor") > 0.001, F.col("elongation")))
    return m.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


# all measurements of kept regions, from the parts above; each part brings the regions' geometry in front
_MEASURED = HSV_SQL + f", {_KEPT}" + "".join(", " + part.removeprefix(f"{_GEOMETRY}, ") for part in (_MOMENTS, _PERIMETER, _HOLES, _EULER, _CONVEX, _BLUR))
_MEASURED += f""", spots AS (SELECT image_id, label, y, x FROM regions UNION ALL SELECT image_id, label, y, x FROM holes),
colour AS (SELECT f.image_id, f.label, count(*) AS area, {_COLOUR.replace("6)", "5)")} FROM spots f JOIN hsv USING (image_id, y, x) GROUP BY 1, 2),
blur AS (SELECT image_id, label, (count(*) * sum(l * l) - sum(l) * sum(l))::DOUBLE / (count(*) * count(*)) AS blur_laplacian FROM lap GROUP BY 1, 2),
places AS (SELECT DISTINCT dataset_id, image_id, seq FROM bgr),
measured AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label) - 1 AS i FROM kept JOIN moments USING (image_id, label) JOIN perimeter USING (image_id, label) JOIN euler USING (image_id, label) JOIN convex USING (image_id, label) JOIN colour USING (image_id, label) JOIN blur USING (image_id, label) JOIN places USING (image_id))"""
_ROUNDED = {
    "x": "sx / n", "y": "sy / n", "local_centroid_col": "sx / n - bx", "local_centroid_row": "sy / n - top", "extent": "n / (width * height)", "equivalent_diameter": "sqrt(4 * n / pi())",
    "major": "major", "minor": "minor", "eccentricity": "eccentricity", "angle": "angle", "elongation": "CASE WHEN minor > 0.001 THEN elongation END", "perim": "perim", "blur_laplacian": "blur_laplacian",
    "circ": "4 * pi() * area / nullif(perim * perim, 0)", "circex": "4 * pi() * n / nullif(perim * perim, 0)", "pct_area": "1 - n / area", "perimareaexc": "perim / n", "perimmajor": "perim / nullif(major, 0)", "solidity": "n / convex_area",
}
_MEASUREMENTS = ", ".join(f"round({e}, 5) AS {c}" for c, e in _ROUNDED.items())
_MEASURE = f"""{_MEASURED} SELECT dataset_id, image_id, seq, label, i::INT AS i, bx, top AS "by", width, height, n AS area_exc, (width * height)::BIGINT AS bounding_box_area, area, euler_number, convex_area, {_MEASUREMENTS}, MeanHue, MeanSaturation, MeanValue, StdHue, StdSaturation, StdValue FROM measured"""


@query("measure_objects", _MEASURE, ("bgr", "regions"))
def measure_objects(spark: SparkSession, d: str) -> DataFrame:
    """One row a kept region of the single-channel masks with all measurements."""
    return rounded(G.measure(labelled(spark, d), T.scanlines(spark, d), MIN_ESD))


@query("export_objects", f"""{_MEASURED} SELECT dataset_id::VARCHAR AS acq_id, image_id || '_' || i AS object_id, area_exc_::VARCHAR AS object_area_exc, area::VARCHAR AS "object_area", convex_area::VARCHAR AS object_convex_area, euler_number::VARCHAR AS object_euler_number, bx::VARCHAR AS object_bx, width::VARCHAR AS object_width FROM (SELECT *, n AS area_exc_ FROM measured)""", ("bgr", "regions"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """The measurement table exported under the export's own names, and read back; whole numbers are compared as text."""
    to = files_.scratch(spark, "export")
    files_.export_tsv(G.export_table(G.measure(labelled(spark, d), T.scanlines(spark, d), MIN_ESD)), to)
    read = files_.read_export_tsv(spark, to)
    return read.select("acq_id", "object_id", "object_area_exc", "object_area", "object_convex_area", "object_euler_number", "object_bx", "object_width")


@query("segment_datasets")
def segment_datasets(spark: SparkSession, d: str) -> DataFrame:
    """The default pipeline with background, correction, triangle threshold, morphology and feedback."""
    return rounded(G.segment(T.scanlines(spark, d), MIN_ESD))
