"""Queries that sum up records: flag rates, means of vectors, maps, samples of frames; SQL builds on that of the records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import stats
from ..operators import cloud as C
from ..operators import image as I
from ..operators import spectral as S
from ..operators import text as T
from ..operators import video as V
from ..sources import derived
from .array_queries import BANDS, CLOUDS, CUBE, NIR, RED, _E, clouds, coloured_clouds, cubes, images
from .registry import ORACLE_SQL, query, rounded
from .text_queries import _ROWS, _grams


def _top(n: int) -> str:
    return f"with {_ROWS}, {_grams(n)}, c as (select doc_id, term, count(*)::bigint as count, min(pos) as first from e group by doc_id, term), r as (select *, row_number() over (partition by doc_id order by count desc, first) as rank from c) select doc_id, rank::int as rank, term, count from r where rank <= 30"


@query(_top(2))
def document_top_bigrams(t):
    return T.top_terms_per_document(t("documents"), 30, n=2)


@query(_top(3))
def document_top_trigrams(t):
    return T.top_terms_per_document(t("documents"), 30, n=3)


@query(
    f"with a as ({ORACLE_SQL['image_sharpness']}), b as ({ORACLE_SQL['image_colour']}), f as (select is_blurry, is_grayscale_like from a join b using (image_id)) "
    "select 'is_blurry' as flag, count_if(is_blurry)::bigint as count, round(avg(is_blurry::int), 6) as fraction from f union all select 'is_grayscale_like', count_if(is_grayscale_like)::bigint, round(avg(is_grayscale_like::int), 6) from f"
)
def image_flag_rates(t):
    p = images(t)
    return rounded(stats.rates(I.sharpness(p).join(I.colour(p), I.ID), ["is_blurry", "is_grayscale_like"]))


def _means(source: str, vectors: dict[str, list[str]], digits: int = 6) -> str:
    rows = [f"select '{v}' as vector, {i} as component, round(avg({c}), {digits}) as mean, round(stddev_pop({c}), {digits}) as std from s" for v, cs in vectors.items() for i, c in enumerate(cs)]
    return f"with s as ({source}) " + " union all ".join(rows)


_RGB = {"mean_rgb": ["mean_r", "mean_g", "mean_b"], "std_rgb": ["std_r", "std_g", "std_b"]}
_CLOUD = {"bbox_size": ["span_x", "span_y", "span_z"], "xyz_mean": ["x_mean", "y_mean", "z_mean"], "xyz_std": ["x_std", "y_std", "z_std"]}


@query(_means(ORACLE_SQL["image_channel_stats"], _RGB, 4))
def image_dataset_colour(t):
    return rounded(stats.vector_means(rounded(I.channel_stats(images(t))), _RGB), 4)


@query(_means(ORACLE_SQL["cloud_extent"], _CLOUD, 4))
def cloud_vector_means(t):
    return rounded(stats.vector_means(rounded(C.extent(clouds(t))), _CLOUD), 4)


@query(f"with {CLOUDS} select cloud_id, (3 + (count(intensity) > 0)::int + case when cloud_id in (select label::varchar from embeddings) then 3 else 0 end)::int as n_dims, count(intensity) > 0 as has_intensity, cloud_id in (select label::varchar from embeddings) as has_color from p group by cloud_id")
def cloud_dimensions(t):
    return C.dimensions(coloured_clouds(t))


@query(f"with {BANDS} select cube_id, band, round(coalesce(abs(mean - lag(mean) over (partition by cube_id order by band)), 0), 6) as gradient from bs")
def spectral_gradient(t):
    return rounded(S.gradient(cubes(t)))


@query(f"with {CUBE} select cube_id, row, col, round((b[{NIR + 1}] - b[{RED + 1}]) / (b[{NIR + 1}] + b[{RED + 1}] + 1e-9), 6) as value from px")
def spectral_ndvi_map(t):
    return rounded(S.index_map(cubes(t), "ndvi", 64))


@query()
def spectral_texture(t):
    return rounded(S.texture(cubes(t)))


@query()
def image_frequency_bands(t):
    rec = I.records(I.packed(images(t)))
    return rounded(stats.describe(rec.where("not is_corrupt"), ["freq_low", "freq_mid", "freq_high"]))


_COLOURED = f"f0 as (select label as video_id, (row_number() over (partition by label order by vec_id) - 1)::int as frame_idx, {_E} as e from embeddings), lv as (select video_id, frame_idx, i, list_transform([e[i + 1], e[(i + 1) % 64 + 1], e[(i + 2) % 64 + 1]], lambda v: floor(greatest(0, least(1, v)) * 255)) as c from f0, range(64) t(i))"


@query(f"with {_COLOURED} select video_id, " + ", ".join(f"round({f}(c[{i + 1}] / 255), 6) as {n}_{k}" for n, f in (("mean", "avg"), ("std", "stddev_pop")) for i, k in enumerate("rgb")) + " from lv group by video_id")
def video_colour(t):
    return rounded(V.pixel_colour(derived.colour_videos(t("embeddings"))))


@query(
    f"with {_COLOURED}, n as (select video_id, max(frame_idx) as last, least(max(frame_idx) + 1, 6) - 1 as steps from f0 group by 1), w as (select video_id, case when steps = 0 then 0 else floor(i * last / steps) end as frame_idx from n, range(6) s(i) where i <= steps) "
    "select distinct lv.video_id, lv.frame_idx, i::int as pixel, c[1]::int as r from lv join w on lv.video_id = w.video_id and lv.frame_idx = w.frame_idx"
)
def video_sample_frames(t):
    p = V.sample_frames(derived.colour_videos(t("embeddings")), 6)
    return p.select("video_id", "frame_idx", (F.col("y") * 8 + F.col("x")).cast("int").alias("pixel"), "r")


@query(
    "with v as (select log10(o_totalprice) as v from orders where o_totalprice > 0), e as (select min(v) as a, max(v) as b from v) select least(floor((v - a) / ((b - a) / 30)), 29)::int as bin, round(any_value(a) + least(floor((v - a) / ((b - a) / 30)), 29)::int * ((any_value(b) - any_value(a)) / 30), 6) as lo, "
    "round(any_value(a) + (least(floor((v - a) / ((b - a) / 30)), 29)::int + 1) * ((any_value(b) - any_value(a)) / 30), 6) as hi, count(*)::bigint as count from v, e group by 1, least(floor((v - a) / ((b - a) / 30)), 29)"
)
def metric_log_histogram(t):
    return rounded(stats.histogram(t("orders"), "o_totalprice", 30, log10=True))


@query("with e as (select quantile_cont(o_totalprice, 0.02) as lo, quantile_cont(o_totalprice, 0.98) as hi from orders) select o_orderkey, round((least(greatest(o_totalprice, lo), hi) - lo) / (hi - lo), 6) as scaled from orders, e")
def metric_percentile_clip(t):
    return rounded(stats.percentile_clip(t("orders"), "o_totalprice", "scaled").select("o_orderkey", "scaled"))
