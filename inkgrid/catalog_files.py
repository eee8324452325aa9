"""Registered queries of files, shipped assets and table functions, with their SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from .catalog import PIX, _pixels, query, table
from .catalog_rows import _joined, _square, by_row, dealt
from .functions.tables import register_tables
from .operators.corpus import DRAWN
from .options import Options
from .plans.pipeline import Models, Pipeline, checked
from .schemas import IMAGES
from .sessions import DarkSession
from .sources import images, pixels
from .sources.assets import fetch_assets, ship
from .sources.datasource import read_pictures, write_pictures
from .sources.drawing import line_crops, overlays
from .sources.stores import scratch, store_of


def _texts_as_files(spark, sf):
    """A folder with one file for each document, named by its number."""
    folder = scratch(spark, "texts")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.encode("text", "UTF-8").alias("content"))
    write_pictures(docs, folder, extension="txt")
    return folder


def _number(path: str):
    """The number that names a file."""
    return F.regexp_extract(path, r"([0-9]+)\.[a-z]+$", 1).cast("long")


@query("select doc_id, sha256(text) as sha, octet_length(encode(text)) as bytes from documents where text is not null")
def files_round_trip(spark, sf):
    """Texts written as files by the sink and read by the source, as they are."""
    files = read_pictures(spark, _texts_as_files(spark, sf), recursive=True, decode=False, partitionBytes=1 << 20)
    return files.select(_number("image_id").alias("doc_id"), F.sha2("content", 256).alias("sha"), F.length("content").cast("long").alias("bytes"))


@query("""select doc_id, case when doc_id % 3 = 0 then 'failed' else 'fetched' end as status, case when doc_id % 3 = 0 then 'failed' else 'kept' end as again from documents where text is not null""")
def fetched_assets(spark, sf):
    """Files brought to a folder with their sums; those with a wrong sum stay out, and a second call finds the others there."""
    listed = read_pictures(spark, _texts_as_files(spark, sf), recursive=True, decode=False)
    number = _number("image_id")
    sums = F.when(number % 3 == 0, F.lit("0" * 64)).when(number % 3 == 1, F.sha2("content", 256))
    plan = listed.select(F.col("image_id").alias("url"), sums.alias("sha256")).persist()  # both calls read it twice

    def opener(url):
        store, path = store_of(url)
        return store.open_input_stream(path)

    folder = scratch(spark, "fetched")
    first = fetch_assets(plan, folder, opener).select("url", "status").persist()  # else it would be fetched again below
    first.count()
    second = fetch_assets(plan, folder, opener).select("url", F.col("status").alias("again"))
    return first.join(second, "url").select(_number("url").alias("doc_id"), "status", "again")


@query("""
with n as (select n_nationkey, n_name, row_number() over (order by n_nationkey) - 1 as line from nation)
select c_custkey, n_name as token, line + 1 as class from customer join n on c_nationkey = n_nationkey""")
def shipped_dictionary(spark, sf):
    """A dictionary file of the nations' names, shipped to the workers with its sum and looked up there."""
    nations = table(spark, sf, "nation").orderBy("n_nationkey").limit(1000).collect()  # a dimension of 25 rows
    text = "".join(f"{r.n_name}\n" for r in nations).encode()
    folder = scratch(spark, "dictionary")
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/names.txt") as out:
        out.write(text)
    asset = ship(spark, f"{folder}/names.txt", hashlib.sha256(text).hexdigest())
    line = {r.n_nationkey: i for i, r in enumerate(nations)}

    def classes(it):
        names = asset.lines()
        for pdf in it:
            at = pdf["c_nationkey"].map(line).astype(int)
            yield pdf[["c_custkey"]].assign(token=[names[i] for i in at], **{"class": at + 1})

    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").mapInPandas(classes, "c_custkey long, token string, class long")


@query(f"""with {PIX} select vec_id, 8 as height, 8 as width, array_to_string(list_transform(range(0, 192), lambda i: v[i // 3 + 1]), ',') as flat from px""")
def picture_files(spark, sf):
    """Squares encoded as PNG, written by the sink and decoded by the source; all pixels."""
    squares = by_row(dealt(_pixels(spark, sf)).select(F.col("vec_id").cast("string").alias("image_id"), "v"), "image_id string, content binary", lambda v: (pixels.encode_png(_square(v, 8, 8)),))
    folder = scratch(spark, "squares")
    write_pictures(squares, folder)
    found = read_pictures(spark, folder, recursive=True, partitionBytes=1 << 20)
    out = by_row(found.select("image_id", "image"), "image_id string, height int, width int, flat string", lambda x: (x["height"], x["width"], _joined(images.array_of(x))))
    return out.select(_number("image_id").alias("vec_id"), "height", "width", "flat")


def flat_jpeg(levels: list[int]) -> bytes:
    """A gray JPEG, 8 pixels high, with a block of one level for each of ``levels``: steps of 8, so a difference of one is a level."""
    bits, last = "", 128
    for level in levels:
        d, last = level - last, level
        size = abs(d).bit_length()
        bits += f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "0"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    part = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    frame = bytes([8, 0, 8]) + (8 * len(levels)).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    codes = part(0xC4, bytes([0, 0, 0, 0, 12] + [0] * 12 + list(range(12)))) + part(0xC4, bytes([16, 1] + [0] * 15 + [0]))
    return b"\xff\xd8" + part(0xDB, b"\0" + bytes([8] * 64)) + part(0xC0, frame) + codes + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


@query(f"""with {PIX} select vec_id, 8 as height, 512 as width, array_to_string(v, ',') as levels, cast(list_sum(v) * 192 as bigint) as light from px""")
def jpeg_bytes(spark, sf):
    """JPEG in a bytes column, one block for each value; the blocks' levels and the sum over all pixels and channels."""
    files = by_row(dealt(_pixels(spark, sf)).select(F.col("vec_id").cast("string").alias("image_id"), "v"), "image_id string, content binary", lambda v: (flat_jpeg([int(x) for x in v]),))

    def seen(x):
        a = images.array_of(x)
        flat = bool((a.reshape(8, -1, 8, 3) == a[:1, ::8, None]).all())
        return x["height"], x["width"], _joined(a[3, 5::8, 1]) if flat else "blocks are not flat", int(a.astype(np.int64).sum())

    out = by_row(images.decode(files).select("image_id", "image"), "image_id string, height int, width int, levels string, light long", seen)
    return out.select(F.col("image_id").cast("long").alias("vec_id"), "height", "width", "levels", "light")


@query(f"""
with {PIX} select vec_id, array_to_string(list_transform(range(0, 192), lambda i: case when i // 3 % 8 between 1 and 6 and i // 24 between 2 and 5 then (v[i // 3 + 1] + (case i % 3 when 0 then 113 when 1 then 71 else 29 end)) // 2 else v[i // 3 + 1] end), ',') as flat from px""")
def blended_boxes(spark, sf):
    """A page blended by half with one filled box: all pixels of the overlay's left side."""
    gray = lambda v: np.dstack([_square(v, 8, 8)] * 3)
    pages = by_row(dealt(_pixels(spark, sf)).select(F.col("vec_id").cast("string").alias("image_id"), "v"), "image_id string, content binary", lambda v: (pixels.encode_png(gray(v)),))
    box = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((1, 2), (6, 2), (6, 5), (1, 5))))
    lines = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.lit(0).alias("box_idx"), box.alias("box"), F.lit("text").alias("txt"), F.lit(0.9).alias("rec_score"))
    seen = overlays(images.decode(pages), lines, "beside")
    out = by_row(images.decode(seen).select("image_id", "image"), "image_id string, flat string", lambda x: (_joined(images.array_of(x)[:, :8]),))
    return out.select(F.col("image_id").cast("long").alias("vec_id"), "flat")


@query(f"""
with {PIX}, b as (select * from (values (0, 0, 0, 4, 3), (1, 2, 1, 7, 6), (2, 3, 3, 3, 7)) as b(box_idx, x0, y0, x1, y1))
select vec_id, box_idx, case when x1 > x0 then array_to_string(list_transform(range(0, (x1 - x0) * (y1 - y0)), lambda i: v[(y0 + i // (x1 - x0)) * 8 + x0 + i % (x1 - x0) + 1]), ',') else 'a box without area' end as flat from px, b""")
def page_crops(spark, sf):
    """Crops of three boxes of every page, at the page's own scale; one box has no area."""
    pages = by_row(dealt(_pixels(spark, sf)).select(F.col("vec_id").cast("string").alias("image_id"), "v"), "image_id string, content binary", lambda v: (pixels.encode_png(_square(v, 8, 8)),))
    box = lambda x0, y0, x1, y1: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
    boxes = F.posexplode(F.array(box(0, 0, 4, 3), box(2, 1, 7, 6), box(3, 3, 3, 7))).alias("box_idx", "box")
    crops = line_crops(images.decode(pages), table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), boxes))
    key = F.concat("image_id", F.lit(":"), F.col("box_idx").cast("string")).alias("key")
    out = by_row(crops.select(key, "image", "error"), "key string, flat string", lambda image, error: (error or _joined(images.array_of(image)[:, :, 0]),))
    return out.select(F.substring_index("key", ":", 1).cast("long").alias("vec_id"), F.substring_index("key", ":", -1).cast("int").alias("box_idx"), "flat")


# -- metrics -------------------------------------------------------------------------------------


def barred_page(key: int) -> np.ndarray:
    """A white page of 64 x 128 with up to three dark bars."""
    page = np.full((64, 128, 3), 255, np.uint8)
    for i in range(key % 4):
        page[6 + 19 * i : 15 + 19 * i, 10 + key % 20 : 60 + key % 50] = 0
    return page


@query("""
select count(*) as pages, count(*) filter (k % 7 = 0) as failed_pages, 0::bigint as unexpected_pages, count(*) filter (k % 7 > 0 and k % 4 = 0) as empty_pages, sum(case when k % 7 > 0 then k % 4 else 0 end)::bigint as lines,
  count(*) filter (k % 7 > 0) > 0 as timed from (select p_partkey as k from part)""")
def observed_pages(spark, sf):
    """Metrics that one pass over drawn pages reports of itself; every seventh page has no picture."""

    def draw(it):
        for pdf in it:
            for lo in range(0, len(pdf), DRAWN):
                rows = [(str(k), None, "no content") if k % 7 == 0 else (str(k), images.image_row(str(k), barred_page(k)), None) for k in pdf["p_partkey"][lo : lo + DRAWN]]
                yield pd.DataFrame(rows, columns=["image_id", "image", "error"])

    keys = table(spark, sf, "part").select("p_partkey")
    parts = max(keys.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    seen = Observation()
    pipeline = Pipeline(Models(det=DarkSession), Options().with_values({"Det.limit_side_len": 32}))
    pipeline.transform(keys.repartition(parts).mapInPandas(draw, IMAGES), seen).write.format("noop").mode("overwrite").save()
    got = checked(seen.get, 0.0)
    row = [got[c] for c in ("pages", "failed_pages", "unexpected_pages", "empty_pages", "lines")]
    return spark.createDataFrame([(*row, got["det_seconds"] > 0)], "pages long, failed_pages long, unexpected_pages long, empty_pages long, lines long, timed boolean")


# -- table functions -----------------------------------------------------------------------------


@query(r"""
with l as (select doc_id, unnest(range(len(ls))) as ln, ls from (select doc_id, string_split(text, chr(10)) as ls from documents)),
w as (select doc_id, ln, list_filter(string_split_regex(ls[ln + 1], '[\x09-\x0d\x20]+'), lambda x: x <> '') as w from l),
k as (select doc_id, ln, unnest(range(len(w))) as k, w from w), t as (select doc_id, ln, k, w[k + 1] as txt from k)
select doc_id, ln::int as box_idx, (row_number() over (partition by doc_id order by ln, k) - 1)::int as word_idx, txt, length(txt)::double as x from t where length(txt) % 7 > 0""")
def words_of_pages(spark, sf):
    """Words of all lines, numbered over their page by a table function; every seventh length has no box."""
    register_tables(spark)
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    box = lambda x: F.when(F.length(x) % 7 > 0, F.array(F.struct(F.length(x).cast("double").alias("x"), F.lit(0.0).alias("y"))))
    word = lambda x: F.struct(x.alias("txt"), F.lit(1.0).alias("conf"), box(x).alias("box"))
    words = F.transform(F.filter(F.split("line", r"[\x09-\x0d\x20]+"), lambda x: x != ""), word)
    lines.select(F.col("doc_id").cast("string").alias("image_id"), F.col("ln").alias("box_idx"), words.alias("words")).createOrReplaceTempView("_inkgrid_lines")
    return spark.sql("select cast(image_id as long) as doc_id, box_idx, word_idx, txt, box[0].x as x from explode_words(TABLE(_inkgrid_lines) PARTITION BY image_id ORDER BY box_idx)")


@query("""
with recursive cell as (select vec_id, i, i % 10 as x, i // 10 as y, i % 10 between 1 and 8 and i // 10 between 1 and 8 and coalesce(e[(i // 10 - 1) * 8 + i % 10], 0) > 0.02e0 and i % 10 < 9 as ink
  from (select vec_id, embedding as e, unnest(range(0, 100)) as i from embeddings)),
fore as (select vec_id, i, x, y, i as root from cell where ink union select c.vec_id, c.i, c.x, c.y, f.root from fore f join cell c on c.vec_id = f.vec_id and c.ink and abs(c.x - f.x) <= 1 and abs(c.y - f.y) <= 1),
back as (select vec_id, i, x, y, i as root from cell where not ink union select c.vec_id, c.i, c.x, c.y, f.root from back f join cell c on c.vec_id = f.vec_id and not c.ink and abs(c.x - f.x) + abs(c.y - f.y) = 1),
region as (select vec_id, i, any_value(x) as x, any_value(y) as y, min(root) as k from fore group by vec_id, i),
ground as (select vec_id, i, any_value(x) as x, any_value(y) as y, min(root) as g from back group by vec_id, i),
-- a region's first cell has its ground to the left, a hole's first cell its region
border as (select r.vec_id, r.i, false as hole, k, g from region r join ground b on b.vec_id = r.vec_id and b.i = r.i - 1 where r.i = k
  union all select b.vec_id, b.i, true, k, g from ground b join region r on r.vec_id = b.vec_id and r.i = b.i - 1 where b.i = g and g > 0),
first as (select *, row_number() over (partition by vec_id order by i desc) - 1 as region from border),
beside as (select distinct r.vec_id, k, g, r.x, r.y from region r join ground b on b.vec_id = r.vec_id and abs(b.x - r.x) + abs(b.y - r.y) = 1)
select vec_id, region::int as region, hole, count(*) as cells, min(x) - 1 as x0, min(y) - 1 as y0, max(x) - 1 as x1, max(y) - 1 as y1 from first join beside using (vec_id, k, g) where region < 3 group by vec_id, region, hole""")
def candidate_regions(spark, sf):
    """The first three borders that the detector would examine on maps with more regions and holes than that."""
    register_tables(spark)
    rows = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("embedding", y * 8 + 1, F.lit(8)).cast("array<double>"))).alias("y", "probs")
    table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), rows).createOrReplaceTempView("_inkgrid_maps")
    return spark.sql("select cast(image_id as long) as vec_id, region, hole, cells, x0, y0, x1, y1 from regions_of_map(TABLE(_inkgrid_maps) PARTITION BY (image_id), 0.02D, 3)")
