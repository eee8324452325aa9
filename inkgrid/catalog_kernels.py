"""More registered queries: pixel and geometry kernels as the pipeline runs them, layout step by step, options and catalogs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalog import BOXES, KEY, ORDER, PIX, REG, REQ, SAMPLE, TIES, VOCAB, _pixels, _requests, boxes, query, table
from .catalog_rows import _joined, _square, by_row, dealt
from .functions import arrays as A
from .functions import geometry as G
from .functions import text as X
from .functions.bidi import displayed
from .functions.register import register_functions
from .operators import detection, layout, recognition, registry, results
from .options import OptionError, Options
from .sources import images, pixels


# -- pixels --------------------------------------------------------------------------------------


@query(f"""with {PIX} select vec_id, array_to_string(list_transform(range(0, 96), lambda i: least(255, case when v[i // 3 * 2 + 2] > 0 then v[i // 3 * 2 + 1] else 0 end + 255 - v[i // 3 * 2 + 2])), ',') as flat from px""")
def gray_alpha_kernel(spark, sf):
    return by_row(_pixels(spark, sf), "vec_id long, flat string", lambda v: (_joined(pixels.to_bgr(_square(v, 4, 8, 2))),))


@query(f"""
with {PIX}, q as (select vec_id, v, list_filter(list_transform(range(0, 16), lambda i: {{'l': 299 * v[i*4+1] + 587 * v[i*4+2] + 114 * v[i*4+3], 'a': v[i*4+4]}}), lambda p: p.a > 0) as p from px),
g as (select vec_id, v, case when len(p) = 0 or list_sum(list_transform(p, lambda x: x.l)) < 128000 * len(p) then 255 else 0 end as ground from q)
select vec_id, ground, array_to_string(list_transform(range(0, 48), lambda i: floor(v[i // 3 * 4 + 3 - i % 3]::float * (v[i // 3 * 4 + 4]::float / 255::float) + ground::float * (1::float - v[i // 3 * 4 + 4]::float / 255::float))::integer), ',') as flat from g""")
def rgba_kernel(spark, sf):
    """Blending of all images, in single precision on both sides."""

    def kernel(v):
        a = _square(v, 4, 4, 4)
        return pixels.background(a), _joined(pixels.to_bgr(a))

    return by_row(_pixels(spark, sf), "vec_id long, ground int, flat string", kernel)


@query(f"""with {PIX} select vec_id, array_to_string(list_transform(range(0, 48), lambda i: round_even((v[i % 16 * 3 + i // 16 + 1] / 255e0 - 0.5e0) / 0.5e0 * 1e4, 0)::integer), ',') as flat from px""")
def normalize_chw(spark, sf):
    """Values in ten thousandths, channels first."""
    return by_row(_pixels(spark, sf), "vec_id long, flat string", lambda v: (_joined(np.rint(pixels.normalize(_square(v, 4, 4, 3)) * 1e4).astype(int)),))


@query(f"""
with {PIX}, t as (select vec_id, v, 1 + vec_id % 8 as o from px)
select vec_id, o as orientation, array_to_string(list_transform(range(0, 64), lambda i: v[case o when 1 then i when 2 then i // 8 * 8 + 7 - i % 8 when 3 then 63 - i when 4 then (7 - i // 8) * 8 + i % 8
  when 5 then i % 8 * 8 + i // 8 when 6 then (7 - i % 8) * 8 + i // 8 when 7 then (7 - i % 8) * 8 + 7 - i // 8 else i % 8 * 8 + 7 - i // 8 end + 1]), ',') as flat from t""")
def exif_orientations(spark, sf):
    df = _pixels(spark, sf).withColumn("o", (F.col("vec_id") % 8 + 1).cast("int"))
    return by_row(df.select("vec_id", "o", "v"), "vec_id long, orientation long, flat string", lambda o, v: (o, _joined(pixels.upright(_square(v, 8, 8), o))))


@query(f"""with {PIX} select cast(vec_id as varchar) as image_id, cast(list_sum(v) * 3 as bigint) as light, 8 as height, 8 as width, array_to_string(list_transform(range(0, 192), lambda i: v[i // 3 + 1]), ',') as flat from px""")
def png_round_trip(spark, sf):
    """Gray squares encoded, decoded as files are and brought to BGR."""
    files = by_row(dealt(_pixels(spark, sf)).select(F.col("vec_id").cast("string").alias("image_id"), "v"), "image_id string, content binary", lambda v: (pixels.encode_png(_square(v, 8, 8)),))
    df = images.decode(files).select("image_id", "image")
    out = by_row(df, "image_id string, light long, height int, width int, flat string", lambda x: (int(images.array_of(x).sum()), x["height"], x["width"], _joined(images.array_of(x))))
    return out


@query(f"""with {PIX}, t as (select vec_id, v, vec_id % 3 = 0 as turned from px) select vec_id, turned, array_to_string(list_transform(range(0, 64), lambda i: v[case when turned then 64 - i else i + 1 end]), ',') as flat from t""")
def half_turns(spark, sf):
    label, score = F.when(F.col("vec_id") % 3 == 0, "180").otherwise("0"), F.lit(0.95)
    df = _pixels(spark, sf).withColumn("turned", results.should_turn(label, score))
    return by_row(df.select("vec_id", "turned", "v"), "vec_id long, turned boolean, flat string", lambda t, v: (t, _joined(pixels.half_turn(_square(v, 8, 8)) if t else _square(v, 8, 8))))


@query(f"""with {PIX} select vec_id, array_to_string(list_transform(range(0, 15), lambda i: v[(i // 5 + 2) * 8 + i % 5 + 2]), ',') as flat from px""")
def straight_crops(spark, sf):
    """A box along the axes: the perspective crop is the pixels themselves."""
    box = np.array([[1, 2], [6, 2], [6, 5], [1, 5]], float)
    return by_row(_pixels(spark, sf), "vec_id long, flat string", lambda v: (_joined(pixels.straighten(_square(v, 8, 8, 1), box)),))


# -- geometry ------------------------------------------------------------------------------------


@query(f"""
with {BOXES}, c as (select *, x0 + w / 2e0 as mx, y0 + h / 2e0 as my, cos(radians(30)) as c, sin(radians(30)) as s from boxes)
select img, box_idx, pk, sk, round((x0 - mx) * c + (y0 - my) * s + mx, 6) as x, round((y0 - my) * c - (x0 - mx) * s + my, 6) as y from c""")
def rotate_points(spark, sf):
    mid = lambda a, b: F.col(a) + F.col(b) / F.lit(2.0)
    p = G.rotate_point(F.col("x0"), F.col("y0"), mid("x0", "w"), mid("y0", "h"), 30)
    return boxes(spark, sf).withColumn("p", p).select(*KEY, F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("""
with p as (select p_partkey as id, p_partkey % 90 as ax, p_partkey * 7 % 80 as ay, 20 + p_partkey % 11 as ux, p_partkey % 5 as uy, -(p_partkey % 3) as vx, 10 + p_partkey % 7 as vy from part)
select id, round(ax + ux * 0.25e0 + vx * 0.5e0, 4) as x, round(ay + uy * 0.25e0 + vy * 0.5e0, 4) as y from p""")
def inverse_perspective(spark, sf):
    """A quarter along the upper edge and half way down, back onto a slanted box."""
    k = F.col("p_partkey")
    df = dealt(table(spark, sf, "part").select(k.alias("id"), (k % 90).alias("ax"), (k * 7 % 80).alias("ay"), (k % 11 + 20).alias("ux"), (k % 5).alias("uy"), (-(k % 3)).alias("vx"), (k % 7 + 10).alias("vy")))

    def kernel(ax, ay, ux, uy, vx, vy):
        quad = np.array([[ax, ay], [ax + ux, ay + uy], [ax + ux + vx, ay + uy + vy], [ax + vx, ay + vy]], float)
        x, y = pixels.project(pixels.homography(np.array([[0, 0], [40, 0], [40, 20], [0, 20]], float), quad), np.array([[10.0, 10.0]]))[0]
        return x, y

    out = by_row(df, "id long, x double, y double", kernel)
    return out.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""
with p as (select p_partkey as id, p_partkey % 90 as x0, p_partkey * 7 % 80 as y0, 20 + p_partkey % 11 as w, 10 + p_partkey % 7 as h from part)
select id, x0 as left_x, y0 as top_y, x0 + w as right_x, y0 + h as low_y, cast(trunc(x0 + w // 4) as bigint) as word_x0, cast(trunc(x0 + w // 2) as bigint) as word_x1 from p""")
def corners_and_words(spark, sf):
    """Shuffled corners put in order, and a word of the crop back on the page."""
    k = F.col("p_partkey")
    df = dealt(table(spark, sf, "part").select(k.alias("id"), (k % 90).alias("x0"), (k * 7 % 80).alias("y0"), (k % 11 + 20).alias("w"), (k % 7 + 10).alias("h")))

    def kernel(x0, y0, w, h):
        box = pixels.clockwise_quad(np.array([[x0 + w, y0 + h], [x0, y0], [x0 + w, y0], [x0, y0 + h]], float))
        cell = np.array([[w // 4 + 0.25, 0.25], [w // 2 + 0.25, 0.25], [w // 2 + 0.25, h - 0.25], [w // 4 + 0.25, h - 0.25]])
        word = pixels.words_on_page(box, [cell], False)[0]
        return *box[0].astype(int).tolist(), *box[2].astype(int).tolist(), int(word[0][0]), int(word[1][0])

    return by_row(df, "id long, left_x long, top_y long, right_x long, low_y long, word_x0 long, word_x1 long", kernel)


@query("""with p as (select p_partkey as id, 1 + p_partkey % 23 as a, 1 + p_partkey * 7 % 19 as b from part) select id, round(5e0 * least(a, b), 6) as short, round(25e0 * a * b, 4) as area from p""")
def smallest_rectangles(spark, sf):
    """Points on the edges and inside of a rectangle turned by a 3-4-5 angle."""
    k = F.col("p_partkey")

    def kernel(a, b):
        u, v = np.array([4, 3]) * a, np.array([-3, 4]) * b
        points = np.array([s * u + t * v for s in (0, 0.5, 1) for t in (0, 0.25, 1)]) + [50, 20]
        corners, short = detection.smallest_rectangle(points)
        return short, float(np.linalg.norm(corners[0] - corners[1]) * np.linalg.norm(corners[0] - corners[3]))

    out = by_row(dealt(table(spark, sf, "part").select(k.alias("id"), (k % 23 + 1).alias("a"), (k * 7 % 19 + 1).alias("b"))), "id long, short double, area double", kernel)
    return out.select("id", F.round("short", 6).alias("short"), F.round("area", 4).alias("area"))


@query(f"""
with {BOXES} select img, box_idx, pk, sk, cast(greatest(0, least(1199, round_even(x0 / 900e0 * 1200e0, 0))) as integer) as x, cast(greatest(0, least(99, round_even(y0 / 160e0 * 100e0, 0))) as integer) as y from boxes""")
def rescaled_corners(spark, sf):
    """All corners of a batch at once."""

    def run(it):
        for pdf in it:
            on = detection.on_page(pdf[["x0", "y0"]].to_numpy(float), 160, 900, 100, 1200)
            yield pdf[KEY].assign(x=on[:, 0], y=on[:, 1])

    df = boxes(spark, sf).select(*KEY, "x0", "y0")
    kinds = {c: df.schema[c].dataType.simpleString() for c in KEY}
    return df.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", x int, y int")


@query("""select p_partkey as id, cast(4 + p_partkey % 50 as integer) as h, cast(5 + p_partkey % 70 as integer) as w, 1e0 as ratio_h, 1e0 as ratio_w, false as failed from part""")
def resize_gate(spark, sf):
    k = F.col("p_partkey")
    df = table(spark, sf, "part").select(k.alias("id"), G.bound_sides((k % 50 + 4).cast("int"), (k % 70 + 5).cast("int"), enabled=False).alias("s"))
    return df.select("id", "s.*")


# -- layout --------------------------------------------------------------------------------------


_PAIRS = f"""{BOXES}, n as (select *, lag(y0) over v as by0, lag(h) over v as bh, lag(x0) over v as bx0, lag(w) over v as bw from boxes window v as (partition by img order by y0, {ORDER})), pairs as (select * from n where by0 is not null)"""


def _pairs(spark, sf):
    from pyspark.sql import Window

    v = Window.partitionBy("img").orderBy("y0", *TIES)
    df = boxes(spark, sf).withColumn("p", layout.line_props(G.rectangle("x0", "y0", "w", "h")))
    return df.withColumn("b", F.lag("p").over(v)).where("b is not null")


@query(f"""
with {_PAIRS} select img, box_idx, pk, sk, greatest(0, least(y0 + h, by0 + bh) - greatest(y0, by0)) / cast(greatest(1, least(h, bh)) as double) > 0.5e0
  or abs((2 * y0 + h) / 2e0 - (2 * by0 + bh) / 2e0) < greatest(1, least(h, bh)) * 0.35e0 as together from pairs""")
def same_line(spark, sf):
    return _pairs(spark, sf).select(*KEY, G.same_line(F.col("b"), F.col("p")).alias("together"))


@query(f"""
with {_PAIRS}, m as (select *, least(y0, by0) as t, greatest(y0 + h, by0 + bh) as b, least(x0, bx0) as l, greatest(x0 + w, bx0 + bw) as r from pairs)
select img, box_idx, pk, sk, cast(t as double) as top, cast(b as double) as bottom, cast(l as double) as "left", cast(r as double) as "right", cast(b - t as double) as height, cast(r - l as double) as width, (t + b) / 2e0 as center_y from m""")
def merged_line_props(spark, sf):
    return _pairs(spark, sf).select(*KEY, layout.merged_props(F.col("b"), F.col("p")).alias("m")).select(*KEY, "m.*")


@query(f"""
with recursive {BOXES}, it as (select img, row_number() over (partition by img order by (2 * y0 + h) / 2e0, x0, box_idx) as n,
  {{'t': cast(y0 as double), 'b': cast(y0 + h as double), 'l': cast(x0 as double), 'r': cast(x0 + w as double), 'txt': 't' || pk}} as x from boxes),
fold as (
  select img, 1 as n, [{{'t': x.t, 'b': x.b, 'l': x.l, 'r': x.r, 'items': [x]}}] as ls from it where n = 1
  union all
  select img, n + 1, case when hit is null then list_append(ls, {{'t': x.t, 'b': x.b, 'l': x.l, 'r': x.r, 'items': [x]}})
    else list_transform(ls, lambda y, k: case when k = hit then {{'t': least(y.t, x.t), 'b': greatest(y.b, x.b), 'l': least(y.l, x.l), 'r': greatest(y.r, x.r), 'items': list_append(y.items, x)}} else y end) end
  from (select fold.img, fold.n, ls, x, list_filter(range(1, len(ls) + 1), lambda k: greatest(0, least(ls[k].b, x.b) - greatest(ls[k].t, x.t)) / greatest(1, least(ls[k].b - ls[k].t, x.b - x.t)) > 0.5e0
      or abs((ls[k].t + ls[k].b) / 2 - (x.t + x.b) / 2) < greatest(1, least(ls[k].b - ls[k].t, x.b - x.t)) * 0.35e0)[1] as hit
    from fold join it on it.img = fold.img and it.n = fold.n + 1)),
last_ as (select img, list_sort(list_transform(ls, lambda y, k: {{'a': y.t, 'b': y.l, 'k': k, 'y': y}})) as ls from fold qualify n = max(n) over (partition by img)),
line_ as (select img, k, ls[k].y as y, case when k > 1 then ls[k - 1].y end as before, list_sort(list_transform(ls[k].y.items, lambda x, j: {{'l': x.l, 'j': j, 'x': x}})) as s from (select img, ls, unnest(range(1, len(ls) + 1)) as k from last_)),
text_ as (select img, k, case when k > 1 and y.t - before.b > greatest(before.b - before.t, y.b - y.t) * 0.8e0 then chr(10) else '' end
  || array_to_string(list_transform(range(1, len(s) + 1), lambda j: case when j = 1 then '' else repeat(' ', cast(case when s[j].x.l - s[j - 1].x.r <= 1 then 0 else least(12, greatest(1, round_even(
    (s[j].x.l - s[j - 1].x.r) / greatest(1e0, least(s[j - 1].x.r - s[j - 1].x.l, s[j].x.r - s[j].x.l) * 0.5e0), 0))) end as bigint)) end || s[j].x.txt), '') as t from line_)
select img, string_agg(t, chr(10) order by k) as markdown from text_ group by img""")
def ocr_to_markdown(spark, sf):
    """Items fold into lines one by one; the SQL does so by recursion. box_idx is no key of an image, so items that the SQL takes for equal follow each other by pk and sk."""
    df = boxes(spark, sf).withColumns({"box": G.rectangle("x0", "y0", "w", "h"), "txt": F.concat(F.lit("t"), F.col("pk").cast("string")), "at": F.struct("box_idx", "pk", "sk")})
    return layout.to_markdown(df, "img", "at")


# -- results -------------------------------------------------------------------------------------

_SEEN = """seen as (select l_orderkey as img, l_linenumber as box_idx, l_partkey as pk, l_suppkey as sk, case when l_partkey % 3 > 0 then 1 end as b, case when l_partkey % 5 > 1 then 1 end as t,
  case when l_suppkey % 2 = 0 then 1 end as c, case when l_suppkey % 4 > 0 then 0.5e0 end as s from lineitem)"""


@query(f"""
with {_SEEN} select img, box_idx, pk, sk, case when b is not null and t is not null then 'ocr' when b is not null then 'det' when t is not null then 'rec' when c is not null then 'cls' else 'empty' end as kind,
  b is not null and t is not null and s is not null as shown, case when s is not null then printf('180 %.2f', s) end as cls_label, (box_idx * 67 + 29) % 256 as red from seen""")
def result_kinds(spark, sf):
    q = lambda c, m, ok: F.when(ok(F.col(c) % m), 1)
    b, t, c = q("pk", 3, lambda x: x > 0), q("pk", 5, lambda x: x > 1), q("sk", 2, lambda x: x == 0)
    df = boxes(spark, sf).select(*KEY, b.alias("b"), t.alias("t"), c.alias("c"), F.when(F.col("sk") % 4 > 0, 0.5).alias("s"))
    label = F.when(F.col("s").isNotNull(), X.score_label(F.lit("180"), F.col("s")))
    return df.select(*KEY, results.result_kind(F.col("b"), F.col("t"), F.col("c")).alias("kind"), results.can_be_shown(F.col("b"), F.col("t"), F.col("s")).alias("shown"), label.alias("cls_label"), results.colour(F.col("box_idx"))["red"].alias("red"))


_WORDS = """wd as (select doc_id, k, w[k] as txt from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from (select doc_id, list_filter(string_split_regex(text, '[\\x09-\\x0d\\x20]+'), lambda x: x <> '') as w from documents)))"""


def _words(spark, sf):
    w = F.filter(F.split("text", r"[\x09-\x0d\x20]+"), lambda x: x != "")
    box = lambda x: F.when(F.length(x) % 3 > 0, F.array(G.point(F.lit(0.0), F.length(x).cast("double"))))
    word = lambda x: F.struct(F.when(F.length(x) % 5 > 0, x).alias("txt"), F.lit(0.5).alias("conf"), box(x).alias("box"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.lit(0).alias("box_idx"), F.transform(w, word).alias("words"))


@query(f"""with {_WORDS} select doc_id as image_id, count(*) as n, string_agg(case when length(txt) % 5 > 0 then txt else '-' end, '|' order by k) as words from wd where length(txt) % 3 > 0 group by doc_id""")
def words_with_boxes(spark, sf):
    df = results.drop_empty_words(_words(spark, sf))
    return df.select("image_id", F.size("words").cast("long").alias("n"), F.array_join(F.transform("words", lambda w: F.coalesce(w["txt"], F.lit("-"))), "|").alias("words"))


@query(f"""with {_WORDS} select doc_id as image_id, k - 1 as word_idx, txt, 0.5e0 as conf, cast(length(txt) as double) as y from wd where length(txt) % 3 > 0 and length(txt) % 5 > 0""")
def flat_words(spark, sf):
    return results.flat_words(_words(spark, sf)).select("image_id", F.col("word_idx").cast("long").alias("word_idx"), "txt", "conf", F.get("box", F.lit(0))["y"].alias("y"))


# -- recognition ---------------------------------------------------------------------------------


@query("""
with l as (select doc_id, unnest(range(len(ls))) as ln, ls from (select doc_id, string_split(text, chr(10)) as ls from documents)), t as (select doc_id, ln, ls[ln + 1] as line, (doc_id + ln) % 6 as c from l)
select doc_id, ln::int as ln, cast(least(c, case when line[1] = 'A' then 3 else 2 end) as integer) as gap from t where line <> ''""")
def first_gaps(spark, sf):
    """The gap before every line; capital A stands in for CJK."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line")).where("line <> ''")
    ch = F.translate(F.substring("line", 1, 1), "A", "文")
    return lines.select("doc_id", "ln", recognition.first_gap(((F.col("doc_id") + F.col("ln")) % 6).cast("int"), ch).alias("gap"))


@query("select 0 as class, 'blank' as token union all select r_regionkey + 1, r_name from region union all select count(*) + 1, ' ' from region")
def recogniser_vocabulary(spark, sf):
    names = [r.r_name for r in table(spark, sf, "region").orderBy("r_regionkey").collect()]  # a fixed table of five rows
    return spark.createDataFrame(list(enumerate(recognition.vocabulary(names))), "class long, token string")


#: Letters of a right-to-left script stand in for a to j.
RTL_FROM, RTL_TO = "abcdefghij", "אבגדהוזחטי"


@query(f"""
with w as (select doc_id, regexp_replace(lower(text), '[^a-j]', '', 'g') as w from documents) select doc_id, translate(reverse(w), '{RTL_FROM}', '{RTL_TO}') as shown from w""")
def right_to_left(spark, sf):
    w = F.regexp_replace(F.lower("text"), "[^a-j]", "")
    return table(spark, sf, "documents").select("doc_id", displayed(F.translate(w, RTL_FROM, RTL_TO)).alias("shown"))


@query(f"""
with c as (select doc_id, string_split(translate(text, 'bcdefghijklmnopqrstuvwxyz', 'bbbbbbbbbbbbbbbbbbbbbbbbb'), '') as cs from documents)
select doc_id, array_to_string(list_transform(cs, lambda x: coalesce(list_position([{", ".join(f"'{t}'" for t in VOCAB)}], x) - 1, -1)), ',') as classes from c""")
def character_classes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.char_classes(F.translate("text", "bcdefghijklmnopqrstuvwxyz", "b" * 25), VOCAB).alias("classes"))


# -- arrays --------------------------------------------------------------------------------------


@query(f"""
with {PIX} select vec_id, array_to_string(list_transform([63, 0, 7, 7], lambda i: v[i + 1]), ',') as picked, array_to_string(list_filter(v, lambda x: x > 128), ',') as bright,
  array_to_string(list_transform(range(2, 65), lambda i: v[i] - v[i - 1]), ',') as steps, array_to_string(flatten([v[1:8], v[57:64]]), ',') as rows from px""")
def array_views(spark, sf):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    v = F.col("v")
    rows = F.flatten(F.array(F.slice(v, 1, 8), F.slice(v, 57, 8)))
    picked, bright = A.gather(v, F.array(*map(F.lit, (63, 0, 7, 7)))), A.select_mask(v, F.transform(v, lambda x: x > 128))
    return _pixels(spark, sf).select("vec_id", join(picked).alias("picked"), join(bright).alias("bright"), join(A.differences(v)).alias("steps"), join(rows).alias("rows"))


@query(r"""
select doc_id, regexp_matches(text, '[éñß]') as marked, length(regexp_replace(text, '^[\x09-\x0d\x1c-\x20\x85\xa0]+|[\x09-\x0d\x1c-\x20\x85\xa0]+$', '', 'g')) as kept, regexp_full_match(text, '[\x09-\x0d\x1c-\x20\x85\xa0]*') as blank,
  cast(case when n_chars % 97 + 3 <= 30 or (doc_id % 900) / cast(n_chars % 97 + 3 as double) > 8 then trunc(abs(greatest(trunc(doc_id % 900 / 8e0), 30) * 2 - (n_chars % 97 + 3)) / 2e0) else 0 end as integer) as pad from documents""")
def sql_functions(spark, sf):
    """The functions that are registered for SQL; letters with marks stand in for CJK."""
    register_functions(spark)
    table(spark, sf, "documents").createOrReplaceTempView("_inkgrid_documents")
    return spark.sql("""select doc_id, is_cjk(translate(text, 'éñß', '文文文')) as marked, cast(length(strip_text(text)) as long) as kept, is_blank_text(text) as blank,
      padding_rows(cast(n_chars % 97 + 3 as int), cast(doc_id % 900 as int)) as pad from _inkgrid_documents""")


# -- options and catalogs ------------------------------------------------------------------------

@query("""
select doc_id, case when doc_id % 3 = 0 then (doc_id % 10) / 10e0 else 0.3e0 end as thresh, case when doc_id % 2 = 0 then (doc_id % 7) / 7e0 else 0.5e0 end as text_score, case when doc_id % 5 = 0 then (doc_id % 11)::int + 1 else 6 end as batch,
  case when lang in ('en', 'latin') then lang else 'ch' end as lang_type, 1.6e0 as unclip_ratio, case when doc_id % 13 = 0 then 'OptionError' when doc_id % 17 = 0 then 'TypeError' end as refused from documents""")
def merged_options(spark, sf):
    """For every document: defaults, a saved and reloaded tree, dotted overrides on it; unknown names and values are refused."""

    def merged(k, lang):
        tree = Options().with_values({"Rec.lang_type": lang} if lang in ("en", "latin") else {})
        again = Options({name: tree[name] for name in tree})
        changes = {name: value for ok, name, value in ((k % 3 == 0, "Det.thresh", k % 10 / 10), (k % 2 == 0, "Global.text_score", k % 7 / 7), (k % 5 == 0, "Rec.rec_batch_num", k % 11 + 1)) if ok}
        refused = None
        try:
            again.with_values({"Det.threshold": 1} if k % 13 == 0 else {"Rec.ocr_version": "none"} if k % 17 == 0 else {})
        except (OptionError, TypeError) as e:
            refused = type(e).__name__
        flat = again.with_values(changes).flat()
        return *(flat[x] for x in ("Det.thresh", "Global.text_score", "Rec.rec_batch_num", "Rec.lang_type", "Det.unclip_ratio")), refused

    return by_row(table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("k"), "lang"), "doc_id long, thresh double, text_score double, batch int, lang_type string, unclip_ratio double, refused string", merged)


@query(f"""
with {REG}, {REQ}, j as (select q.*, r.model_dir, r.sha256, row_number() over (partition by doc_id order by ord) as n from req q left join reg r on r.engine = q.engine and r.version = q.version and r.task = q.task
  and case when q.version = 'PP-OCRv6' then r.model_key = 'multi_PP-OCRv6_rec_' || q.model_type else starts_with(r.model_key, q.lang) and contains(r.model_key, q.model_type) end)
select model_dir as path, min(sha256) as sha256, count(*) as n, false as conflict from j where n = 1 and model_dir is not null group by model_dir""")
def download_plan(spark, sf):
    """The files that all documents' requests need, each once."""
    found = registry.find_models(_requests(spark, sf).withColumn("request_id", F.col("doc_id")), registry.registry(spark, SAMPLE))
    return registry.deduplicated(found.where("model_dir is not null").select(F.col("model_dir").alias("path"), "sha256"))


@query("""select distinct lang || '/' || source as path from documents where source not in (select source from documents where doc_id % 7 = 0 and source < 'src4')""")
def missing_files(spark, sf):
    d = table(spark, sf, "documents")
    key = F.concat_ws("/", "lang", "source").alias("path")
    there = d.where((F.col("doc_id") % 7 == 0) & (F.col("source") < "src4")).select("source").distinct().join(d, "source").select(key)
    return registry.missing_files(d.where("source is not null").select(key), there)


@query(r"""select page_id, regexp_extract(url, '[^/]*$') as base, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\.[^.]*$', '\1') as stem from pages""")
def path_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.basename("url").alias("base"), X.stem("url").alias("stem"))
