"""Registered queries of the document-text engine: each operator on tables, with the SQL that says the same.

Boxes are derived from ``lineitem`` by whole-number arithmetic, model outputs and pixels from ``embeddings``, text lines
from ``documents``; every order ends with a unique key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays as A
from .functions import geometry as G
from .functions import numeric as N
from .functions import text as X
from .operators import corpus, detection, layout, ordering, recognition, registry, results, words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


KEY = ["img", "box_idx", "pk", "sk"]


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("box_idx"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        ((F.col("l_partkey") * 37) % 900).alias("x0"), ((F.col("l_suppkey") * 91 + F.col("l_partkey")) % 120).alias("y0"), (q * 4 + 20).alias("w"), (F.col("l_partkey") % 40 + 10).alias("h"),
        ((F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 1000 / F.lit(1000.0)).alias("score"),
    )


BOXES = """boxes as (select l_orderkey as img, l_linenumber as box_idx, l_partkey as pk, l_suppkey as sk, (l_partkey * 37) % 900 as x0,
  (l_suppkey * 91 + l_partkey) % 120 as y0, cast(l_quantity as bigint) * 4 + 20 as w, l_partkey % 40 + 10 as h,
  cast((l_orderkey * 31 + l_linenumber * 17) % 1000 as double) / 1e3 as score from lineitem)"""
ORDER = "box_idx, pk, sk, w"
TIES = ["box_idx", "pk", "sk", "w"]


def quad(df: DataFrame) -> DataFrame:
    """A box whose right and lower edges are askew."""
    p = [G.point(F.col("x0"), F.col("y0")), G.point(F.col("x0") + F.col("w"), F.col("y0") + F.col("pk") % 7), G.point(F.col("x0") + F.col("w"), F.col("y0") + F.col("h")), G.point(F.col("x0"), F.col("y0") + F.col("h") + F.col("sk") % 5)]
    return df.withColumn("box", F.array(*p))


QUAD = BOXES + """, quads as (select *, x0 as ax, y0 as ay, x0 + w as bx, y0 + pk % 7 as by_, x0 + w as cx, y0 + h as cy, x0 as dx, y0 + h + sk % 5 as dy from boxes),
sides as (select *, sqrt(cast((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_) as double)) as ab, sqrt(cast((bx-cx)*(bx-cx)+(by_-cy)*(by_-cy) as double)) as bc,
  sqrt(cast((cx-dx)*(cx-dx)+(cy-dy)*(cy-dy) as double)) as cd, sqrt(cast((ax-dx)*(ax-dx)+(ay-dy)*(ay-dy) as double)) as ad from quads)"""

# -- order and batches ---------------------------------------------------------------------------


@query(f"""
with {BOXES}, a as (select *, case when y0 - lag(y0) over (partition by img order by y0, {ORDER}) >= 10 then 1 else 0 end as n from boxes),
b as (select *, cast(sum(n) over (partition by img order by y0, {ORDER} rows unbounded preceding) as integer) as line_id from a)
select img, box_idx, pk, sk, line_id, cast(row_number() over (partition by img order by line_id, x0, y0, {ORDER}) - 1 as integer) as reading_rank from b""")
def reading_order(spark, sf):
    return ordering.reading_order(boxes(spark, sf), "img", ties=TIES).select(*KEY, "line_id", "reading_rank")


@query(f"""
with {BOXES}, r as (select *, cast(w as double) / h as ratio from boxes),
b as (select *, cast(floor((row_number() over (partition by img order by ratio, {ORDER}) - 1) / 6.0) as integer) as batch from r)
select img, box_idx, pk, sk, batch, greatest(320e0 / 48e0, max(ratio) over (partition by img, batch)) as max_ratio,
  cast(trunc(48e0 * greatest(320e0 / 48e0, max(ratio) over (partition by img, batch))) as integer) as input_width from b""")
def aspect_batches(spark, sf):
    df = ordering.aspect_batches(boxes(spark, sf), F.col("w").cast("double") / F.col("h"), "img", TIES)
    return df.select(*KEY, "batch", "max_ratio", G.batch_width("max_ratio").alias("input_width"))


# -- recognition ---------------------------------------------------------------------------------

VOCAB = ["blank", "a", "b", " "]
PATH = """m as (select vec_id, list_transform(range(0, 16), lambda t: embedding[t * 4 + 1 : t * 4 + 4]) as rows from embeddings),
p as (select vec_id, list_transform(rows, lambda r: list_position(r, list_max(r)) - 1) as idx, list_transform(rows, lambda r: cast(list_max(r) as double)) as conf from m),
k as (select *, list_filter(range(1, 17), lambda t: idx[t] <> 0 and (t = 1 or idx[t] <> idx[t - 1])) as steps from p)"""


def _decoded(spark, sf):
    return recognition.ctc_decode(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 4, F.array(*map(F.lit, VOCAB)))


@query(f"""
with {PATH} select vec_id, coalesce(array_to_string(list_transform(steps, lambda t: (['blank', 'a', 'b', ' '])[idx[t] + 1]), ''), '') as txt, cast(len(steps) as integer) as kept from k""")
def ctc_greedy_decode(spark, sf):
    return _decoded(spark, sf).select("vec_id", "txt", F.size("steps").alias("kept"))


@query(f"""
with {PATH}, c as (select vec_id, list_transform(steps, lambda t: round_even(conf[t] * 1e5, 0) / 1e5) as confs from k)
select vec_id, case when len(confs) = 0 then 0e0 else round_even(list_sum(confs) / len(confs) * 1e5, 0) / 1e5 end as score from c""")
def ctc_line_score(spark, sf):
    return _decoded(spark, sf).select("vec_id", "score")


@query(f"""
with {PATH} select vec_id, 16 * (1 + vec_id % 5) / 6e0 as line_txt_len from k""")
def ctc_usable_columns(spark, sf):
    ratio = (F.col("vec_id") % 5 + 1).cast("double")
    return _decoded(spark, sf).select("vec_id", recognition.usable_columns(F.lit(16), ratio, F.lit(6.0)).alias("line_txt_len"))


#: Letters that stand in for CJK, which the tables don't have.
CJK_FROM, CJK_TO = "aeo", "中文字"
LINES = f"""lines as (select doc_id, ln, ls[ln] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as ln from
  (select doc_id, string_split(translate(text, '{CJK_FROM}', '{CJK_TO}'), chr(10)) as ls from documents)))"""


def _lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.translate("text", CJK_FROM, CJK_TO), "\n")).alias("ln", "line"))
    return d.select("doc_id", (F.col("ln") + 1).cast("long").alias("ln"), "line")


@query(rf"""
with {LINES}, c as (select doc_id, ln, i, cs[i] as ch from (select doc_id, ln, cs, unnest(range(1, len(cs) + 1)) as i from (select doc_id, ln, string_split(line, '') as cs from lines))),
t as (select *, regexp_matches(ch, '^[\x09-\x0d\x1c-\x20\x85\xa0]$') as sp, case when regexp_matches(ch, '[一-鿿　-〿＀-￯]') then 'cn' else 'en' end as ty, i - 1 + 5 * ((i - 1) // 9) as pos from c),
f as (select *, case when sp then 0 when lag(i) over w is null or lag(sp) over w or lag(ty) over w <> ty or pos - lag(pos) over w > 5 then 1 else 0 end as st from t window w as (partition by doc_id, ln order by i)),
g as (select *, sum(st) over (partition by doc_id, ln order by i rows unbounded preceding) as wd from f),
h as (select doc_id, ln, wd, string_agg(ch, '' order by i) as word from g where not sp group by all)
select doc_id, ln, count(wd) as n_words, coalesce(string_agg(word, '|' order by wd), '') as words from lines left join h using (doc_id, ln) group by doc_id, ln""")
def ctc_word_segments(spark, sf):
    df = _lines(spark, sf).withColumn("chars", X.chars("line"))
    df = df.withColumn("cols", F.transform("chars", lambda c, i: (i + F.floor(i / F.lit(9)) * 5).cast("int")))
    df = recognition.word_segments(df, "chars", "cols")
    return df.select("doc_id", "ln", F.size("words").cast("long").alias("n_words"), F.array_join(F.transform("words", lambda w: F.array_join(w["chars"], "")), "|").alias("words"))


@query("""
with a as (select vec_id, embedding[1:2] as e from embeddings), b as (select vec_id, list_position(e, list_max(e)) - 1 as i, cast(list_max(e) as double) * 4e0 as score from a)
select vec_id, (['0', '180'])[i + 1] as label, score, i = 1 and score > 0.9e0 as turned from b""")
def orientation_classify(spark, sf):
    e = F.slice("embedding", 1, 2)
    df = table(spark, sf, "embeddings").select("vec_id", A.argmax(e).alias("i"), (F.array_max(e).cast("double") * 4.0).alias("score"))
    df = df.withColumn("label", F.get(F.array(F.lit("0"), F.lit("180")), F.col("i")))
    return df.select("vec_id", "label", "score", results.should_turn("label", "score").alias("turned"))


# -- sizes ---------------------------------------------------------------------------------------

PAGES = """pages_ as (select l_orderkey as img, l_linenumber as box_idx, l_partkey as pk, l_suppkey as sk, cast(4 + (l_partkey * 53) % 3000 as double) as h,
  cast(4 + (l_suppkey * 97 + l_orderkey * 13) % 3000 as double) as w from lineitem)"""


def _pages(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("img"), F.col("l_linenumber").alias("box_idx"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), ((F.col("l_partkey") * 53) % 3000 + 4).cast("double").alias("h"), ((F.col("l_suppkey") * 97 + F.col("l_orderkey") * 13) % 3000 + 4).cast("double").alias("w"))


@query(f"""
with {PAGES}, a as (select *, 2000e0 / greatest(h, w) as r, greatest(h, w) > 2000 as big from pages_),
b as (select *, case when big then round_even(trunc(h * r) / 32e0, 0) * 32 else h end as h1, case when big then round_even(trunc(w * r) / 32e0, 0) * 32 else w end as w1 from a),
c as (select *, h1 <= 0 or w1 <= 0 as f1, 30e0 / least(h1, w1) as r2, least(h1, w1) < 30 as low from b),
d as (select *, case when f1 then null when low then round_even(trunc(h1 * r2) / 32e0, 0) * 32 else h1 end as h2, case when f1 then null when low then round_even(trunc(w1 * r2) / 32e0, 0) * 32 else w1 end as w2 from c)
select img, box_idx, pk, sk, cast(h2 as integer) as new_h, cast(w2 as integer) as new_w, case when f1 then null when big then h / h1 else 1e0 end * case when low then h1 / h2 else 1e0 end as ratio_h,
  case when f1 then null when big then w / w1 else 1e0 end * case when low then w1 / w2 else 1e0 end as ratio_w, f1 or coalesce(h2 <= 0 or w2 <= 0, true) as failed from d""")
def resize_bounds(spark, sf):
    df = _pages(spark, sf).withColumn("one", G.bound_longest("h", "w")).withColumn("two", G.raise_shortest("one.h", "one.w"))
    failed = F.col("one.failed") | F.coalesce(F.col("two.failed"), F.lit(True))
    return df.select(*KEY, F.col("two.h").alias("new_h"), F.col("two.w").alias("new_w"), (F.col("one.ratio_h") * F.col("two.ratio_h")).alias("ratio_h"), (F.col("one.ratio_w") * F.col("two.ratio_w")).alias("ratio_w"), failed.alias("failed"))


@query(f"""
with {PAGES} select img, box_idx, pk, sk, cast(case when h <= 30 or w / h > 8 then trunc(abs(greatest(trunc(w / 8e0), 30) * 2 - h) / 2e0) else 0 end as integer) as pad from pages_""")
def vertical_padding(spark, sf):
    return _pages(spark, sf).select(*KEY, G.padding("h", "w").alias("pad"))


@query(f"""
with {PAGES}, a as (select *, greatest(h, w) as m, least(h, w) as n from pages_), b as (select *, case when m < 960 then 960 when m < 1500 then 1500 else 2000 end as lim from a),
c as (select *, case when n < 736 then 736e0 / n else 1e0 end as r, case when m > lim then cast(lim as double) / m else 1e0 end as s from b),
d as (select *, round_even(trunc(h * r) / 32e0, 0) * 32 as gh, round_even(trunc(w * r) / 32e0, 0) * 32 as gw, round_even(trunc(h * s) / 32e0, 0) * 32 as sh, round_even(trunc(w * s) / 32e0, 0) * 32 as sw from c)
select img, box_idx, pk, sk, cast(lim as integer) as side_limit, cast(case when gh > 0 and gw > 0 then gh end as integer) as grown_h, cast(case when gh > 0 and gw > 0 then gw end as integer) as grown_w,
  cast(case when sh > 0 and sw > 0 then sh end as integer) as shrunk_h, cast(case when sh > 0 and sw > 0 then sw end as integer) as shrunk_w from d""")
def detector_resize(spark, sf):
    df = _pages(spark, sf).withColumn("side_limit", G.detector_limit(F.greatest("h", "w"), "max")).withColumn("g", G.detector_size("h", "w", F.lit(736))).withColumn("s", G.detector_size("h", "w", "side_limit", "max"))
    return df.select(*KEY, "side_limit", F.col("g.h").alias("grown_h"), F.col("g.w").alias("grown_w"), F.col("s.h").alias("shrunk_h"), F.col("s.w").alias("shrunk_w"))


@query(f"""
with {BOXES}, m as (select *, greatest(0e0, least(700e0, (x0 - 3) * 0.75e0)) as ax, greatest(0e0, least(120e0, (y0 - 5) * 1.25e0)) as ay,
  greatest(0e0, least(700e0, (x0 + w - 3) * 0.75e0)) as cx, greatest(0e0, least(120e0, (y0 + h - 5) * 1.25e0)) as cy from boxes)
select img, box_idx, pk, sk, ax, ay, cx, cy, cast(trunc(greatest(0, least(699, cx))) as integer) as clip_x, cast(trunc(greatest(0, least(119, cy))) as integer) as clip_y from m""")
def box_map_back(spark, sf):
    df = boxes(spark, sf).withColumn("m", G.map_back(G.rectangle("x0", "y0", "w", "h"), F.lit(5), F.lit(3), F.lit(1.25), F.lit(0.75), F.lit(120), F.lit(700)))
    df = df.withColumn("c", G.clip_box("m", F.lit(120), F.lit(700)))
    a, c, k = F.get("m", F.lit(0)), F.get("m", F.lit(2)), F.get("c", F.lit(2))
    return df.select(*KEY, a["x"].alias("ax"), a["y"].alias("ay"), c["x"].alias("cx"), c["y"].alias("cy"), k["x"].alias("clip_x"), k["y"].alias("clip_y"))


@query(f"""
with {QUAD}, s as (select *, cast(trunc(greatest(ab, cd)) as integer) as crop_w, cast(trunc(greatest(ad, bc)) as integer) as crop_h from sides)
select img, box_idx, pk, sk, crop_w, crop_h, cast(crop_h as double) / crop_w >= 1.5e0 as turned, cast(round_even(crop_h * 1.3e0, 0) as integer) as page_h, cast(round_even(crop_w * 0.7e0, 0) as integer) as page_w,
  cast(least(ceil(48e0 * crop_w / crop_h), 192) as integer) as cls_w from s""")
def crop_dims(spark, sf):
    df = quad(boxes(spark, sf)).withColumn("c", G.crop_size("box")).withColumn("p", G.crop_on_page("c.h", "c.w", F.lit(1.3), F.lit(0.7)))
    return df.select(*KEY, F.col("c.w").alias("crop_w"), F.col("c.h").alias("crop_h"), F.col("c.turned").alias("turned"), F.col("p.h").alias("page_h"), F.col("p.w").alias("page_w"), G.padded_width("c.h", "c.w", 48, 192).alias("cls_w"))


@query(f"""
with {BOXES}, q as (select *, w * (13 + pk % 5) / 10e0 as left_h, w * (13 + sk % 5) / 10e0 as right_h from boxes),
e as (select *, sqrt(cast(w * w as double)) as up, sqrt((left_h - right_h) * (left_h - right_h) + w * w) as down from q)
select img, box_idx, pk, sk, case when greatest(up, down) < 1e-6 or round_even(greatest(left_h, right_h) / greatest(up, down), 2) >= 1.5e0 then 'vertical' else 'horizontal' end as direction,
  case when up < 1e-6 or round_even(left_h / up, 2) >= 1.5e0 then 'vertical' else 'horizontal' end as by_one_edge from e""")
def box_direction(spark, sf):
    """Quads whose left and right edges differ by so much that one edge alone would often tell another direction."""
    x0, y0, w = (F.col(c).cast("double") for c in ("x0", "y0", "w"))
    high = lambda c: F.col("w") * (F.col(c) % 5 + 13) / F.lit(10.0)
    box = F.array(G.point(x0, y0), G.point(x0 + w, y0), G.point(x0 + w, y0 + high("sk")), G.point(x0, y0 + high("pk")))
    one = F.when(N.half_even(high("pk") / w, 2) >= 1.5, "vertical").otherwise("horizontal")
    return boxes(spark, sf).select(*KEY, G.direction(box).alias("direction"), one.alias("by_one_edge"))


@query(f"""
with {QUAD}, p as (select img, box_idx, pk, sk, list_sort([{{'x': cx, 'y': cy}}, {{'x': ax, 'y': ay}}, {{'x': dx, 'y': dy}}, {{'x': bx, 'y': by_}}]) as s from quads),
h as (select *, list_sort([{{'y': s[1].y, 'x': s[1].x}}, {{'y': s[2].y, 'x': s[2].x}}]) as l, list_sort([{{'y': s[3].y, 'x': s[3].x}}, {{'y': s[4].y, 'x': s[4].x}}]) as r from p)
select img, box_idx, pk, sk, l[1].x as x1, l[1].y as y1, r[1].x as x2, r[1].y as y2, r[2].x as x3, r[2].y as y3, l[2].x as x4, l[2].y as y4 from h""")
def order_points_clockwise(spark, sf):
    b = F.col("box")
    df = quad(boxes(spark, sf)).withColumn("o", G.clockwise(F.array(F.get(b, F.lit(2)), F.get(b, F.lit(0)), F.get(b, F.lit(3)), F.get(b, F.lit(1)))))
    return df.select(*KEY, *(F.get("o", F.lit(i))[c].alias(f"{c}{i + 1}") for i in range(4) for c in "xy"))


@query(f"""with {QUAD} select img, min(least(ax, bx, cx, dx)) as "left", min(least(ay, by_, cy, dy)) as top, max(greatest(ax, bx, cx, dx)) as "right", max(greatest(ay, by_, cy, dy)) as bottom, count(*) as n from quads group by img""")
def bbox_of_quads(spark, sf):
    df = quad(boxes(spark, sf)).withColumn("b", G.bounds("box"))
    return df.groupBy("img").agg(F.min("b.left").alias("left"), F.min("b.top").alias("top"), F.max("b.right").alias("right"), F.max("b.bottom").alias("bottom"), F.count(F.lit(1)).alias("n"))


@query(f"""
with {QUAD}, a as (select *, abs(cast(ax*by_ - bx*ay + bx*cy - cx*by_ + cx*dy - dx*cy + dx*ay - ax*dy as double)) / 2e0 as area, ab + bc + cd + ad as around from sides)
select img, box_idx, pk, sk, area, round(around, 6) as around, round(area * 1.6e0 / around, 6) as distance from a""")
def unclip_distance(spark, sf):
    df = quad(boxes(spark, sf))
    return df.select(*KEY, G.area("box").alias("area"), F.round(G.perimeter("box"), 6).alias("around"), F.round(G.unclip_distance("box"), 6).alias("distance"))


@query(f"""
with {BOXES}, d as (select *, cast(w as double) * h * 1.6e0 / (2e0 * (cast(w as double) + h)) as d from boxes)
select img, box_idx, pk, sk, round(d, 6) as d, round(w + d * 2, 6) as grown_w, round(h + d * 2, 6) as grown_h from d""")
def unclip_rect(spark, sf):
    df = boxes(spark, sf).withColumn("u", G.unclip_rectangle("w", "h"))
    return df.select(*KEY, F.round("u.d", 6).alias("d"), F.round("u.w", 6).alias("grown_w"), F.round("u.h", 6).alias("grown_h"))


# -- detection -----------------------------------------------------------------------------------

MASK = "m as (select vec_id, embedding as e, list_transform(embedding, lambda v: case when v > 0.05e0 then 1 else 0 end) as b from embeddings)"


@query(f"""
with {MASK}, d as (select *, list_transform(range(0, 64), lambda i: greatest(b[i + 1], case when i % 8 > 0 then b[i] else 0 end, case when i >= 8 then b[i - 7] else 0 end, case when i % 8 > 0 and i >= 8 then b[i - 8] else 0 end)) as g from m)
select vec_id, array_to_string(b, '') as mask, array_to_string(g, '') as dilated, cast(list_sum(g) as bigint) as cells from d""")
def binarize_dilate(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", detection.binarize("embedding", 0.05).alias("b"))
    df = df.withColumn("g", detection.dilate("b", 8))
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "")
    return df.select("vec_id", join("b").alias("mask"), join("g").alias("dilated"), F.aggregate("g", F.lit(0).cast("long"), lambda s, v: s + v).alias("cells"))


@query("""
select vec_id, round(list_sum(list_transform(list_filter(range(0, 64), lambda i: i % 8 between 2 and 5 and i // 8 between 1 and 6), lambda i: cast(embedding[i + 1] as double))) / 24e0, 6) as score from embeddings""")
def box_score_axis_aligned(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(detection.masked_mean("embedding", 8, 2, 1, 5, 6), 6).alias("score"))


@query("""
with recursive c as (select vec_id, i, i % 8 as x, i // 8 as y from (select vec_id, embedding as e, unnest(range(0, 64)) as i from embeddings) where e[i + 1] > 0.1e0),
walk as (select vec_id, i, x, y, i as root from c union select d.vec_id, d.i, d.x, d.y, w.root from walk w join c d on d.vec_id = w.vec_id and abs(d.x - w.x) <= 1 and abs(d.y - w.y) <= 1),
least_ as (select vec_id, i, x, y, min(root) as region from walk group by all)
select vec_id, region, count(*) as cells, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from (select vec_id, i, any_value(x) as x, any_value(y) as y, min(region) as region from least_ group by vec_id, i) group by vec_id, region""")
def component_boxes(spark, sf):
    return detection.region_bounds(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 8, 0.1)


@query(f"""
with {BOXES}, r as (select *, row_number() over (partition by img order by {ORDER}) as n, cast(w as double) * h * 1.6e0 / (2e0 * (cast(w as double) + h)) as d from boxes)
select img, box_idx, pk, sk, round(w + d * 2, 6) as grown_w, round(h + d * 2, 6) as grown_h from r where n <= 4 and least(w, h) >= 12 and score >= 0.5e0 and least(w + d * 2, h + d * 2) >= 30
  and greatest(0, least(599, round_even(x0 + w + d, 0))) - greatest(0, least(599, round_even(x0 - d, 0))) > 3 and greatest(0, least(99, round_even(y0 + h + d, 0))) - greatest(0, least(99, round_even(y0 - d, 0))) > 3""")
def det_filters(spark, sf):
    df = detection.keep_candidates(boxes(spark, sf), "img", TIES, short=12, short_grown=30, most=4, page=(600, 100))
    return df.select(*KEY, F.round("grown_w", 6).alias("grown_w"), F.round("grown_h", 6).alias("grown_h"))


# -- results -------------------------------------------------------------------------------------


@query(f"""with {BOXES} select img, count(*) as n, sum(w) as total_w from boxes where score >= 0.5e0 group by img""")
def text_score_filter(spark, sf):
    return results.drop_low_scores(boxes(spark, sf), "score").groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total_w"))


@query(rf"""
with {LINES} select doc_id, count(*) as lines_, sum(length(line)) as chars from lines where not regexp_full_match(line, '[\x09-\x0d\x1c-\x20\x85\xa0　]*') group by doc_id""")
def blank_text_filter(spark, sf):
    return results.drop_blank(_lines(spark, sf), "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines_"), F.sum(F.length("line")).cast("long").alias("chars"))


@query(f"""
with {BOXES} select img, case when bool_or(pk % 97 = 0) then 'without txt' end as warning, case when not bool_or(pk % 97 = 0) then '[' || string_agg('{{"box":[[' || x0 || ',' || y0 || '],[' || (x0 + w) || ',' || y0 || '],[' || (x0 + w) || ',' || (y0 + h) || '],[' || x0 || ',' || (y0 + h) || ']],"txt":"t' || pk || '","score":' || score || '}}', ',' order by {ORDER}) || ']' end as json from boxes group by img""")
def ocr_to_json(spark, sf):
    """Some lines have no text: their images have no JSON but a warning."""
    # pages are brought together before their boxes are made, which are several times as large
    df = boxes(spark, sf).repartition("img").withColumns({"box": G.rectangle("x0", "y0", "w", "h"), "txt": F.when(F.col("pk") % 97 != 0, F.concat(F.lit("t"), F.col("pk").cast("string"))), "i": F.struct(*TIES)})
    return layout.to_json(df, "img", "i", "box", "txt", "score")


@query(f"""
with {BOXES}, g as (select *, x0 - lag(x0 + w) over (partition by img order by x0, {ORDER}) as gap, lag(w) over (partition by img order by x0, {ORDER}) as lw from boxes)
select img, box_idx, pk, sk, gap, cast(case when gap <= 1 then 0 else least(12, greatest(1, round_even(gap / greatest(1e0, least(lw, w) * 0.5e0), 0))) end as integer) as spaces from g where gap is not null""")
def gap_spaces(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("img").orderBy("x0", *TIES)
    df = boxes(spark, sf).withColumns({"gap": F.col("x0") - F.lag(F.col("x0") + F.col("w")).over(w), "lw": F.lag("w").over(w)}).where("gap is not null")
    return df.select(*KEY, "gap", G.gap_spaces("gap", "lw", "w").alias("spaces"))


@query(f"""
with {BOXES}, g as (select *, y0 - lag(y0 + h) over (partition by img order by y0, {ORDER}) as gap, lag(h) over (partition by img order by y0, {ORDER}) as lh from boxes)
select img, box_idx, pk, sk, coalesce(gap > greatest(h, lh) * 0.8e0, false) as new_paragraph from g""")
def paragraph_breaks(spark, sf):
    df = boxes(spark, sf).withColumns({"top": F.col("y0"), "bottom": F.col("y0") + F.col("h")})
    return layout.paragraph_breaks(df, "img", ["y0", *TIES]).select(*KEY, "new_paragraph")


@query(f"""
with {BOXES}, c as (select *, w / 40e0 as cw, w / 12e0 as ch from boxes), d as (select *, (pk % 40 + 0.5e0) * cw as mid from c)
select img, box_idx, pk, sk, greatest(cast(trunc(mid - ch / 2) as bigint), 0) + x0 as left_x, least(cast(trunc(mid + ch / 2) as bigint), w) + x0 as right_x from d""")
def char_cells(spark, sf):
    column = words.column_width(F.col("w"), F.lit(40.0))
    df = boxes(spark, sf).withColumn("c", words.char_cell(F.col("pk") % 40, column, F.col("w") / F.lit(12.0), "x0", "w"))
    return df.select(*KEY, F.col("c.x0").cast("long").alias("left_x"), F.col("c.x1").cast("long").alias("right_x"))


@query(f"""
with {BOXES}, c as (select *, w / 40e0 as cw, [pk % 5, pk % 5 + 2, pk % 5 + 4] as a, [pk % 5 + 10, pk % 5 + 13] as b from boxes), d as (select *, ((a[3] - a[1]) * cw / 2 + (b[2] - b[1]) * cw / 1) / 2 as ch from c),
e as (select *, list_transform(a, lambda k: (k + 0.5e0) * cw) as ma, list_transform(b, lambda k: (k + 0.5e0) * cw) as mb from d)
select img, box_idx, pk, sk, round(ch, 6) as char_w, list_min(list_transform(ma, lambda m: greatest(cast(trunc(m - ch / 2) as bigint), 0))) + x0 as a0, list_max(list_transform(ma, lambda m: least(cast(trunc(m + ch / 2) as bigint), w))) + x0 as a1,
  list_min(list_transform(mb, lambda m: greatest(cast(trunc(m - ch / 2) as bigint), 0))) + x0 as b0, list_max(list_transform(mb, lambda m: least(cast(trunc(m + ch / 2) as bigint), w))) + x0 as b1 from e""")
def word_boxes(spark, sf):
    k = (F.col("pk") % 5).cast("int")
    word = lambda *at: F.struct(F.array(*(k + i for i in at)).alias("cols"), F.lit("en&num").alias("type"))
    df = boxes(spark, sf).withColumns({"words": F.array(word(0, 2, 4), word(10, 13)), "cw": words.column_width(F.col("w"), F.lit(40.0))})
    df = df.withColumn("ch", words.char_width(F.col("words"), F.col("cw"), F.col("w"), F.lit(5)))
    df = df.withColumn("cells", F.transform("words", lambda x: words.word_cell(words.cells(x["cols"], F.col("cw"), F.col("ch"), F.col("x0"), F.col("w")))))
    c = [F.get("cells", F.lit(i)) for i in (0, 1)]
    return df.select(*KEY, F.round("ch", 6).alias("char_w"), *(c[i][f"x{e}"].cast("long").alias(f"{n}{e}") for i, n in enumerate("ab") for e in (0, 1)))


@query(f"""
with {BOXES}, n as (select *, lag(x0 + w) over v as pr, lead(x0) over v as nl from boxes window v as (partition by img order by x0, {ORDER}))
select img, box_idx, pk, sk, case when pr > x0 then (pr + x0) / 2e0 else x0 end as left_x, case when x0 + w > nl then (x0 + w + nl) / 2e0 else x0 + w end as right_x from n""")
def overlap_repair(spark, sf):
    df = boxes(spark, sf).withColumns({"o": F.col("x0"), "left_x": F.col("x0").cast("double"), "right_x": (F.col("x0") + F.col("w")).cast("double")})
    return words.overlap_repair(df, ["img"], ["o", *TIES], "left_x", "right_x").select(*KEY, "left_x", "right_x")


@query(f"""
with {BOXES} select img, box_idx, pk, sk, printf('%d:%.3f', box_idx, score) as label, cast(x0 as integer) as anchor_x, cast(y0 as integer) as anchor_y, score >= 0.5e0 as visible, h > w * 2 as vertical,
  cast(greatest(trunc(case when h > w * 2 then w * 0.9e0 else h * 0.8e0 end), 10) as integer) as font_size from boxes""")
def overlay_instructions(spark, sf):
    df = boxes(spark, sf).withColumn("box", G.rectangle("x0", "y0", "w", "h"))
    return results.overlay(df).select(*KEY, "label", "anchor_x", "anchor_y", "visible", "vertical", "font_size")


@query(f"""with {BOXES} select img, box_idx, pk, sk, cast(coalesce(sum(h) over (partition by img order by {ORDER} rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", max(w) over (partition by img) as canvas_width from boxes""")
def stacked_offsets(spark, sf):
    return results.stacked_offsets(boxes(spark, sf), "img", TIES, "h", "w").select(*KEY, "offset", "canvas_width")


@query("""select user_id, round(sum(value), 4) as elapse, count(value) as stages from events group by user_id""")
def stage_elapse_total(spark, sf):
    df = results.total_elapse(table(spark, sf, "events"), ["user_id"], "value")
    return df.select("user_id", F.round("elapse", 4).alias("elapse"), "stages")


# -- pixels --------------------------------------------------------------------------------------

PIX = "px as (select vec_id, list_transform(embedding, lambda v: cast(greatest(0, least(255, floor((cast(v as double) + 0.6e0) * 200e0))) as integer)) as v from embeddings)"


def _pixels(spark, sf):
    value = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.6) * 200.0))).cast("int")
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", value).alias("v"))


@query(f"""
with {PIX}, q as (select vec_id, list_filter(list_transform(range(0, 16), lambda i: {{'l': 299 * v[i*4+1] + 587 * v[i*4+2] + 114 * v[i*4+3], 'a': v[i*4+4]}}), lambda p: p.a > 100) as p from px)
select vec_id, len(p) as shown, cast(list_sum(list_transform(p, lambda x: x.l)) as bigint) as light, case when len(p) = 0 then 255 when list_sum(list_transform(p, lambda x: x.l)) / 1000e0 / len(p) < 128 then 255 else 0 end as background from q""")
def luminance_background(spark, sf):
    df = _pixels(spark, sf).select("vec_id", corpus.luminance("v", 100).alias("s"))
    return df.select("vec_id", F.col("s.shown").cast("long").alias("shown"), F.col("s.light").alias("light"), corpus.background(F.col("s")).alias("background"))


@query(f"""with {PIX} select vec_id, array_to_string(list_transform(range(0, 32), lambda i: least(255, case when v[i*2+2] > 0 then v[i*2+1] else 0 end + 255 - v[i*2+2])), ',') as flat from px""")
def gray_alpha_flatten(spark, sf):
    flat = F.transform(A.matrix_rows(F.col("v").cast("array<float>"), 2), lambda p: N.saturating_add(F.when(F.get(p, F.lit(1)) > 0, F.get(p, F.lit(0))).otherwise(0).cast("int"), F.lit(255) - F.get(p, F.lit(1)).cast("int")))
    return _pixels(spark, sf).select("vec_id", F.array_join(F.transform(flat, lambda v: v.cast("string")), ",").alias("flat"))


@query(f"""with {PIX}, n as (select vec_id, list_transform(v, lambda x: (x / 255e0 - 0.5e0) / 0.5e0) as n from px) select vec_id, n[1] as first, n[64] as last, list_min(n) as low, list_max(n) as high from n""")
def normalize_pixels(spark, sf):
    df = _pixels(spark, sf).withColumn("n", F.transform("v", lambda x: (x / F.lit(255.0) - 0.5) / 0.5))
    return df.select("vec_id", F.get("n", F.lit(0)).alias("first"), F.get("n", F.lit(63)).alias("last"), F.array_min("n").alias("low"), F.array_max("n").alias("high"))


# -- catalog of models ---------------------------------------------------------------------------

#: A small catalog in the shape of a catalog file, for the queries.
SAMPLE = {
    "onnxruntime": {
        "PP-OCRv4": {"rec": {f"{k}_rec_{t}": {"model_dir": f"models/v4/{k}_{t}.onnx", "SHA256": f"{i:064x}", "dict_url": d} for i, (k, t, d) in enumerate([("ch", "mobile", "dicts/ch.txt"), ("ch", "server", None), ("ch_doc", "server", None), ("chinese_cht", "mobile", "dicts/cht.txt"), ("de", "mobile", None), ("en", "mobile", "dicts/en.txt"), ("es", "mobile", None)])}},
        "PP-OCRv6": {"rec": {f"multi_PP-OCRv6_rec_{t}": {"model_dir": f"models/v6/rec_{t}.onnx", "SHA256": f"{i + 64:064x}", "dict_url": None} for i, t in enumerate(("medium", "small", "tiny"))}},
    },
    "paddle": {"PP-OCRv6": {"rec": {"multi_PP-OCRv6_rec_small": {"model_dir": "models/v6/rec_small", "SHA256": "0" * 64, "dict_url": "dicts/v6.txt"}}}},
    "fonts": {"ch": {"path": "fonts/ch.ttf", "SHA256": "1" * 64}, "en": {"path": "fonts/en.ttf", "SHA256": "2" * 64}, "latin": {"path": "fonts/latin.ttf", "SHA256": "3" * 64}},
}


def _values(rows, columns: str) -> str:
    one = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as t({columns})"


REG = "reg as (select * from " + _values(registry.load_registry(SAMPLE), "engine, version, task, model_key, ord, model_dir, sha256, dict_url") + ")"
REQ = "req as (select doc_id, 'onnxruntime' as engine, (['PP-OCRv4', 'PP-OCRv6'])[1 + doc_id % 2] as version, 'rec' as task, lang, (['mobile', 'small', 'server'])[1 + doc_id % 3] as model_type from documents)"


def _requests(spark, sf):
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % n).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.lit("onnxruntime").alias("engine"), pick(["PP-OCRv4", "PP-OCRv6"], 2).alias("version"), F.lit("rec").alias("task"), "lang", pick(["mobile", "small", "server"], 3).alias("model_type"))


@query(f"""
with {REG}, {REQ}, j as (select q.*, r.model_key, r.model_dir, r.dict_url, row_number() over (partition by doc_id order by ord) as n from req q left join reg r on r.engine = q.engine and r.version = q.version and r.task = q.task
  and case when q.version = 'PP-OCRv6' then r.model_key = 'multi_PP-OCRv6_rec_' || q.model_type else starts_with(r.model_key, q.lang) and contains(r.model_key, q.model_type) end)
select doc_id, version, lang, model_type, model_key, model_dir from j where n = 1""")
def resolve_model(spark, sf):
    found = registry.find_models(_requests(spark, sf).withColumn("request_id", F.col("doc_id")), registry.registry(spark, SAMPLE))
    return found.select("doc_id", "version", "lang", "model_type", "model_key", "model_dir")


@query(f"""
with {REG} select doc_id, 'multi_PP-OCRv6_rec_' || (['small', 'tiny'])[1 + doc_id % 2] as model_key, coalesce(p.dict_url, o.dict_url) as dict_url from documents
left join reg p on p.engine = 'paddle' and p.model_key = 'multi_PP-OCRv6_rec_' || (['small', 'tiny'])[1 + doc_id % 2] left join reg o on o.engine = 'onnxruntime' and o.model_key = 'multi_PP-OCRv6_rec_' || (['small', 'tiny'])[1 + doc_id % 2]""")
def dictionary_fallback(spark, sf):
    key = F.concat(F.lit("multi_PP-OCRv6_rec_"), F.get(F.array(F.lit("small"), F.lit("tiny")), (F.col("doc_id") % 2).cast("int")))
    df = table(spark, sf, "documents").select("doc_id", F.lit("PP-OCRv6").alias("version"), F.lit("rec").alias("task"), key.alias("model_key"))
    return registry.dictionary_url(df, registry.registry(spark, SAMPLE)).select("doc_id", "model_key", "dict_url")


ALIAS = "al as (select * from " + _values(list(registry.LANG_ALIASES.items()), "alias, lang_to") + ")"
SPOKEN = "sp as (select doc_id, (['zh', ' JA ', 'ko', 'xx', lang])[1 + doc_id % 5] as name, (['tiny', 'small'])[1 + doc_id % 2] as model_type from documents)"
RES = f"{ALIAS}, {SPOKEN}, rs as (select doc_id, model_type, coalesce(lang_to, lower(trim(name))) as lang_resolved from sp left join al on alias = lower(trim(name)))"
ROUTE = "rt as (select * from " + _values([(t, x) for t in registry.NOT_IN for x in registry.supported_langs("rec", registry.ROUTED_VERSION, t)], "model_type, lang") + ")"


def _spoken(spark, sf):
    n = F.get(F.array(F.lit("zh"), F.lit(" JA "), F.lit("ko"), F.lit("xx"), F.col("lang")), (F.col("doc_id") % 5).cast("int"))
    df = table(spark, sf, "documents").select("doc_id", n.alias("name"), F.get(F.array(F.lit("tiny"), F.lit("small")), (F.col("doc_id") % 2).cast("int")).alias("model_type"))
    return registry.resolve_alias(df, "name").select("doc_id", "model_type", "lang_resolved")


@query(f"with {RES} select doc_id, model_type, lang_resolved from rs")
def lang_alias(spark, sf):
    return _spoken(spark, sf)


@query(f"with {RES}, {ROUTE} select doc_id, model_type, lang_resolved from rs where exists (select 1 from rt where rt.lang = lang_resolved and rt.model_type = rs.model_type)")
def lang_supported(spark, sf):
    return registry.with_support(_spoken(spark, sf)).select("doc_id", "model_type", "lang_resolved")


@query(f"with {RES}, {ROUTE} select doc_id, model_type, lang_resolved from rs where not exists (select 1 from rt where rt.lang = lang_resolved and rt.model_type = rs.model_type)")
def lang_unsupported(spark, sf):
    return registry.with_support(_spoken(spark, sf), supported=False).select("doc_id", "model_type", "lang_resolved")


def _langs(spark, model_type):
    return registry.routes(spark).where((F.col("model_type") == model_type) & (F.col("task") == "rec")).select("lang")


@query(f"with {ROUTE} select lang from rt where model_type = 'tiny' union select lang from documents order by lang")
def lang_sets_union(spark, sf):
    return _langs(spark, "tiny").union(table(spark, sf, "documents").select("lang")).distinct().orderBy("lang")


@query(f"with {ROUTE} select lang from rt where model_type = 'small' except select lang from documents")
def lang_sets_except(spark, sf):
    return _langs(spark, "small").exceptAll(table(spark, sf, "documents").select("lang").distinct())


@query(f"with {ROUTE} select lang from rt where model_type = 'medium' intersect select lang from documents")
def lang_sets_intersect(spark, sf):
    return _langs(spark, "medium").intersect(table(spark, sf, "documents").select("lang"))


@query("with f as (select * from " + _values([(k, v["path"]) for k, v in SAMPLE["fonts"].items()], "lang, path") + ") select doc_id, coalesce(path, 'fonts/ch.ttf') as font from documents d left join f on f.lang = d.lang")
def font_for_lang(spark, sf):
    return registry.font_for(table(spark, sf, "documents").select("doc_id", "lang"), registry.fonts(spark, SAMPLE)).select("doc_id", "font")


@query(r"""select page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') as is_url, regexp_extract(url, '[^/]*$') as base from pages""")
def is_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.is_url("url").alias("is_url"), X.basename("url").alias("base"))


@query("select doc_id, sha256(text) as sha, doc_id % 2 = 0 as fits from documents")
def sha256_checks(spark, sf):
    sha = F.sha2("text", 256)
    expected = F.when(F.col("doc_id") % 2 == 0, sha).otherwise(F.lit("0" * 64))
    return table(spark, sf, "documents").select("doc_id", sha.alias("sha"), (sha == expected).alias("fits"))


@query("select lang, min(sha256(text)) as sha, count(distinct sha256(text)) > 1 as conflict, count(*) as n from documents group by lang")
def asset_conflicts(spark, sf):
    return registry.deduplicated(table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("sha")), "lang", "sha")


@query(r"""
with d as (select lang, source, n_chars, len(string_split(text, chr(10))) as lines_, toxic from documents left join labels using (doc_id))
select lang, source, count(*) as docs, cast(sum(n_chars) as bigint) as chars, cast(max(n_chars) as bigint) as longest, cast(sum(lines_) as bigint) as lines_, cast(coalesce(sum(toxic), 0) as bigint) as toxic from d group by lang, source""")
def corpus_text_stats(spark, sf):
    return corpus.text_stats(table(spark, sf, "documents"), table(spark, sf, "labels"))


# -- whole pipeline ------------------------------------------------------------------------------


@query(r"""
with line as (select k, i, 12 + (k * 7 + i * 31) % 60 as x, 10 + 36 * i as y, 90 + (k * 13 + i * 17) % 120 as w
  from (select p_partkey as k, unnest(range(0, 2 + p_partkey % 3)) as i from part)),
-- the page is enlarged 4.6 times; a pixel is dark where the weights of its dark neighbours multiply to over a half
far as (select *, ceil(4.6e0 * x - 0.5e0)::bigint as j0, floor(4.6e0 * (x + w) - 0.5e0)::bigint as j1, ceil(4.6e0 * y - 0.5e0)::bigint as i0, floor(4.6e0 * (y + 18) - 0.5e0)::bigint as i1 from line),
edge as (select *, list_transform(list_concat(range(j0, j0 + 5), range(j1 - 4, j1 + 1)), lambda j: {'p': (j + 0.5e0) * 320 / 1472 - 0.5e0, 'a': x, 'n': w}) as ex,
  list_transform(list_concat(range(i0, i0 + 5), range(i1 - 4, i1 + 1)), lambda j: {'p': (j + 0.5e0) * 160 / 736 - 0.5e0, 'a': y, 'n': 18::bigint}) as ey from far),
dark as (select *, list_transform(ex, lambda e: case when floor(e.p) between e.a and e.a + e.n - 1 then 2048 - round_even((e.p - floor(e.p)) * 2048, 0) else 0 end + case when floor(e.p) + 1 between e.a and e.a + e.n - 1 then round_even((e.p - floor(e.p)) * 2048, 0) else 0 end) as sx,
  list_transform(ey, lambda e: case when floor(e.p) between e.a and e.a + e.n - 1 then 2048 - round_even((e.p - floor(e.p)) * 2048, 0) else 0 end + case when floor(e.p) + 1 between e.a and e.a + e.n - 1 then round_even((e.p - floor(e.p)) * 2048, 0) else 0 end) as sy from edge),
lost as (select *, list_sum(list_transform(sx, lambda a: len(list_filter(sy, lambda b: a * b <= 2097152))))::bigint as lost, j1 + 1 - j0 as bw, i1 + 1 - i0 as bh from dark),
box as (select *, ((bw * bh - lost)::double / ((bw + 1) * (bh + 1)))::float::double as det_score, bw * bh * 1.6e0 / (2 * (bw + bh)) as d from lost),
page as (select k, i, x, y, w, det_score, greatest(0, least(319, round_even((j0 - d) / 1472 * 320, 0)))::bigint as x0, greatest(0, least(319, round_even((j0 + bw + d) / 1472 * 320, 0)))::bigint as x1,
  greatest(0, least(159, round_even((i0 - d) / 736 * 160, 0)))::bigint as y0, greatest(0, least(159, round_even((i0 + bh + d) / 736 * 160, 0)))::bigint as y1 from box),
-- the crop is brought to a height of 48 and read by the ink of every eight columns
crop as (select *, x1 - x0 as cw, y1 - y0 as ch, least(320, ceil(48e0 * (x1 - x0) / (y1 - y0)))::bigint as wide from page),
rows_ as (select *, list_transform(list_transform(range(0, 48), lambda r: (r + 0.5e0) * ch / 48 - 0.5e0), lambda p: case when greatest(0, floor(p)) between y - y0 and y - y0 + 17 then 2048 - case when p < 0 then 0 else round_even((p - floor(p)) * 2048, 0) end else 0 end
    + case when least(ch - 1, floor(p) + 1) between y - y0 and y - y0 + 17 then case when p < 0 then 0 else round_even((p - floor(p)) * 2048, 0) end else 0 end) as sy from crop),
cols as (select *, list_transform(list_transform(range(0, wide), lambda r: (r + 0.5e0) * cw / wide - 0.5e0), lambda p: case when greatest(0, floor(p)) between x - x0 and x - x0 + w - 1 then 2048 - case when p < 0 then 0 else round_even((p - floor(p)) * 2048, 0) end else 0 end
    + case when least(cw - 1, floor(p) + 1) between x - x0 and x - x0 + w - 1 then case when p < 0 then 0 else round_even((p - floor(p)) * 2048, 0) end else 0 end) as sx from rows_),
ink as (select *, list_transform(sx, lambda a: len(list_filter(sy, lambda b: a * b > 2097152))) as n from cols),
step as (select *, list_transform(range(0, 40), lambda s: coalesce(list_sum(n[s * 8 + 1 : s * 8 + 8]), 0) / 384e0) as ink from ink),
class as (select *, list_transform(ink, lambda v: case when v > 0.02e0 then least(floor(v * 5), 4)::bigint + 1 else 0 end) as c from step)
select cast(k as varchar) as image_id, i::int as box_idx, x0, y0, x1, y1, det_score, '0' as cls_label,
  array_to_string(list_transform(list_filter(range(1, 41), lambda s: c[s] > 0 and (s = 1 or c[s] <> c[s - 1])), lambda s: 'abcd '[c[s]]), '') as txt, 1e0 as rec_score from class""")
def stub_pipeline(spark, sf):
    """Synthetic pages (one for each part) through the pipeline with model doubles, against the arithmetic of what was drawn."""
    lines = corpus.synthetic_lines(table(spark, sf, "part").select("p_partkey"))
    at = lambda k, axis: F.get("box", F.lit(k))[axis].cast("long")
    return lines.select("image_id", "box_idx", at(0, "x").alias("x0"), at(0, "y").alias("y0"), at(2, "x").alias("x1"), at(2, "y").alias("y1"), "det_score", "cls_label", "txt", "rec_score")


@query(f"""
with {BOXES}, {PATH}, a as (select *, case when y0 - lag(y0) over (partition by img order by y0, {ORDER}) >= 10 then 1 else 0 end as n from boxes),
b as (select *, sum(n) over (partition by img order by y0, {ORDER} rows unbounded preceding) as line_id from a),
c as (select *, row_number() over (partition by img order by line_id, x0, y0, {ORDER}) - 1 as rank from b),
t as (select vec_id, coalesce(array_to_string(list_transform(steps, lambda t: (['blank', 'a', 'b', ' '])[idx[t] + 1]), ''), '') as txt from k),
j as (select c.*, txt from c join t on vec_id = (pk * 31 + box_idx) % (select count(*) from embeddings) where score >= 0.5e0 and trim(txt) <> '')
select img, '[' || string_agg('{{"box":[[' || x0 || ',' || y0 || '],[' || (x0 + w) || ',' || y0 || '],[' || (x0 + w) || ',' || (y0 + h) || '],[' || x0 || ',' || (y0 + h) || ']],"txt":"' || txt || '","score":' || score || '}}', ',' order by rank) || ']' as json, null::varchar as warning from j group by img""")
def flagship_page_json(spark, sf):
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes in reading order and batches, decoded text, score filter, one JSON per image."""
    b = ordering.aspect_batches(ordering.reading_order(boxes(spark, sf), "img", ties=TIES), F.col("w").cast("double") / F.col("h"), "img", TIES)
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))
    texts = _decoded(spark, sf).select("vec_id", "txt")
    b = b.join(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col("pk") * 31 + F.col("box_idx"), F.col("n"))).join(texts, "vec_id")
    b = results.drop_blank(results.drop_low_scores(b, "score")).withColumn("box", G.rectangle("x0", "y0", "w", "h"))
    return layout.to_json(b, "img", "reading_rank", "box", "txt", "score")


from . import catalog_files, catalog_kernels  # noqa: E402, F401 - they register their queries here
