"""Queries over spectral cubes, point clouds, images and videos made from the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import stats
from ..operators import cloud as C
from ..operators import dedup, distance
from ..operators import image as I
from ..operators import spectral as S
from ..operators import video as V
from ..sources import derived
from .registry import query, rounded

_E = "list_transform(embedding, lambda x: (x::double + 1) / 2)"
CUBE = f"px as (select label as cube_id, 0 as row, (row_number() over (partition by label order by vec_id) - 1)::int as col, {_E} as b from embeddings), long as (select cube_id, row, col, i::int as band, b[i + 1] as v from px, range(64) r(i))"
BANDS = f"{CUBE}, bs as (select cube_id, band, avg(v) as mean, stddev_pop(v) as std, min(v) as min, max(v) as max, avg(v) / (stddev_pop(v) + 1e-9) as snr from long group by all)"
NIR, RED, GREEN, BLUE = (S.band_for(t, 64) for t in S.TARGETS.values())


def r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in columns)


def cubes(t):
    return derived.cubes(t("embeddings"))


@query(f"with {BANDS} select cube_id, band, {r('mean', 'std', 'min', 'max', 'snr')} from bs")
def spectral_band_stats(t):
    return rounded(S.band_stats(cubes(t)))


@query(f"with {CUBE}, m as (select cube_id, band, quantile_cont(v, 0.5) as m from long group by all) select cube_id, band, round(quantile_cont(abs(v - m), 0.5), 6) as noise_mad from long join m using (cube_id, band) group by all")
def spectral_noise_mad(t):
    return rounded(S.noise_mad(cubes(t)))


@query(f"with {CUBE}, m as (select cube_id, max(v) as m from long group by all) select cube_id, band, round(avg((v = m)::int), 6) as saturation_frac from long join m using (cube_id) group by all")
def spectral_saturation(t):
    return rounded(S.saturation(cubes(t)))


@query(f"with {CUBE} select cube_id, count(*)::bigint as n, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max, round(max(v) - min(v), 6) as dynamic_range from long group by cube_id")
def spectral_global_stats(t):
    return rounded(S.global_stats(cubes(t)))


@query(f"with {BANDS}, w as (select *, abs(mean - lag(mean) over (partition by cube_id order by band)) as step, stddev_pop(std) over (partition by cube_id) as spread from bs) select cube_id, count(*)::bigint as n_bands, round(avg(step), 6) as spectral_smoothness, count_if(std < 0.01 * (spread + 1e-9))::bigint as n_dropout_bands, round(avg(snr), 6) as snr_mean from w group by cube_id")
def spectral_smoothness_dropout(t):
    return rounded(S.smoothness_and_dropout(cubes(t)))


@query(f"with {CUBE}, p as (select a.cube_id, a.band as i, b.band as j, corr(a.v, b.v) as c from long a join long b on a.cube_id = b.cube_id and a.col = b.col and a.band < b.band group by all) select cube_id, round(avg(c), 6) as inter_band_corr from p group by cube_id")
def spectral_interband_correlation(t):
    return rounded(S.interband_correlation(cubes(t)))


@query(f"with {CUBE} select cube_id, row, col, round(list_avg(b), 6) as mean, round(list_stddev_pop(b), 6) as std from px")
def spectral_spatial_maps(t):
    return rounded(S.spatial_maps(cubes(t)))


_IDX = f"""i as (select cube_id, b[{NIR + 1}] as n, b[{RED + 1}] as r, b[{GREEN + 1}] as g, b[{BLUE + 1}] as bl from px),
v as (select cube_id, 'ndvi' as index, (n - r) / (n + r + 1e-9) as v from i union all select cube_id, 'ndwi', (g - n) / (g + n + 1e-9) from i
union all select cube_id, 'evi', 2.5 * (n - r) / (n + 6 * r - 7.5 * bl + 1 + 1e-9) from i union all select cube_id, 'savi', 1.5 * (n - r) / (n + r + 0.5 + 1e-9) from i),
ix as (select cube_id, index, avg(v) as mean, stddev_pop(v) as std from v group by all)"""


@query(f"with {CUBE}, {_IDX} select cube_id, index, {r('mean', 'std')} from ix")
def spectral_indices(t):
    return rounded(S.index_stats(cubes(t), 64))


@query(f"with {CUBE}, {_IDX}, m as (select index, 'mean' as metric, mean as v from ix union all select index, 'std', std from ix) select index, metric, count(v)::bigint as count, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(min(v), 6) as min, round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as p75, round(max(v), 6) as max from m group by all")
def spectral_index_summary(t):
    return S.describe_indices(cubes(t), 64)


@query(f"with {BANDS}, s as (select a.cube_id as id_a, b.cube_id as id_b, sum(a.mean * b.mean) as d from bs a join bs b using (band) group by all), n as (select id_a as id, sqrt(d) + 1e-9 as n from s where id_a = id_b) select id_a, id_b, round(d / (a.n * b.n), 6) as similarity from s join n a on id_a = a.id join n b on id_b = b.id")
def spectral_cosine_diversity(t):
    return rounded(distance.cosine_similarities(S.mean_spectra(cubes(t)), "cube_id", "spectrum"))


@query(f"with {BANDS} select band, round(avg(mean), 6) as mean, round(stddev_pop(mean), 6) as std, round(avg(snr), 6) as snr from bs group by band")
def spectral_cross_cube_spectrum(t):
    return rounded(S.cross_cube_spectrum(cubes(t)))


@query(f"with {CUBE} select band, round(v, 6) as value from long where cube_id = 3 and row = 0 and col = 5")
def spectral_signature(t):
    return rounded(S.signature(cubes(t), 3, 0, 5))


@query(f"with {CUBE}, c as (select cube_id, row, col, b[43] as r, b[22] as g, b[1] as bl from px), e as (select cube_id, min(least(r, g, bl)) as lo, max(greatest(r, g, bl)) as hi from c group by 1) select cube_id, row, col, round((r - lo) / (hi - lo + 1e-9), 6) as r, round((g - lo) / (hi - lo + 1e-9), 6) as g, round((bl - lo) / (hi - lo + 1e-9), 6) as b from c join e using (cube_id)")
def spectral_false_colour(t):
    return rounded(S.false_colour(cubes(t), 64))


@query()
def spectral_pca_variance(t):
    return rounded(S.pca_variance(cubes(t)))


@query()
def spectral_pca_components(t):
    return S.components_for(S.pca_variance(cubes(t)))


@query()
def spectral_pca_scores(t):
    s = S.pca_scores(cubes(t), 3)
    return rounded(s.select("cube_id", "row", "col", *[F.col("scores")[i].alias(f"pc{i + 1}") for i in range(3)]))


# Clouds: each query runs over the clouds of both tables, whole.
CLOUD_A = "select label::varchar as cloud_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as intensity, embedding[5]::double as r, embedding[6]::double as g, embedding[7]::double as b, vec_id from embeddings"
CLOUD_B = "select l_returnflag as cloud_id, l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z, l_tax as intensity from lineitem"
CLOUDS = f"p as (select cloud_id, x, y, z, intensity from ({CLOUD_A}) union all {CLOUD_B})"


def clouds(t):
    a = derived.embedding_clouds(t("embeddings")).withColumn("cloud_id", F.col("cloud_id").cast("string"))
    return a.select("cloud_id", "x", "y", "z", "intensity").unionByName(derived.lineitem_clouds(t("lineitem")))


def coloured_clouds(t):
    """The same with r, g and b, which are null in the clouds of lineitem."""
    a = derived.embedding_clouds(t("embeddings")).withColumn("cloud_id", F.col("cloud_id").cast("string"))
    return a.drop("point_idx").unionByName(derived.lineitem_clouds(t("lineitem")), allowMissingColumns=True)


_EXT = ", ".join(f"min({c}) as {c}_min, max({c}) as {c}_max, avg({c}) as {c}_mean, stddev_pop({c}) as {c}_std, max({c}) - min({c}) as span_{c}" for c in "xyz")
_EXT_NAMES = [f"{c}_{n}" for c in "xyz" for n in ("min", "max", "mean", "std")] + [f"span_{c}" for c in "xyz"]
_VOLUME = " * ".join(f"greatest(span_{c}, 1e-12)" for c in "xyz")


@query(f"with {CLOUDS}, e as (select cloud_id, count(*)::bigint as n_points, {_EXT} from p group by cloud_id), v as (select *, {_VOLUME} as bbox_volume from e) select cloud_id, n_points, {r(*_EXT_NAMES, 'bbox_volume')}, round(n_points / bbox_volume, 6) as density from v")
def cloud_extent(t):
    return rounded(C.extent(clouds(t)))


@query(f"with {CLOUDS} select cloud_id, round(avg(z), 6) as height_mean, round(stddev_pop(z), 6) as height_std, " + ", ".join(f"round(quantile_cont(z, {a / 100}), 6) as z_p{a}" for a in (0, 5, 25, 50, 75, 95, 100)) + " from p group by cloud_id")
def cloud_heights(t):
    return rounded(C.heights(clouds(t)))


@query(f"with {CLOUDS}, c as (select cloud_id, avg(x) as cx, avg(y) as cy, avg(z) as cz from p group by 1), d as (select cloud_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) as d from p join c using (cloud_id)), m as (select cloud_id, avg(d) as m, stddev_pop(d) as s from d group by 1) select cloud_id, round(any_value(m), 6) as radial_distance_mean, round(any_value(s), 6) as radial_distance_std, round(avg((s > 0 and d > m + 3 * s)::int), 6) as outlier_fraction from d join m using (cloud_id) group by cloud_id")
def cloud_radial_outliers(t):
    return rounded(C.radial(clouds(t)))


@query(f"with {CLOUDS}, u as (select cloud_id, round_even(x, 5) as x, round_even(y, 5) as y, round_even(z, 5) as z, count(*) as n from p group by all) select cloud_id, round(1 - count(*)::double / sum(n), 6) as duplicate_fraction from u group by cloud_id")
def cloud_duplicate_fraction(t):
    return rounded(C.duplicate_fraction(clouds(t)))


_UNIT = "greatest(0, least(1, {c} / case when top > 1 then greatest(255, top) else 1 end))"


@query(f"with p as ({CLOUD_A}), m as (select cloud_id, max(greatest(r, g, b)) as top from p group by 1) select cloud_id, round(avg(intensity), 6) as intensity_mean, round(stddev_pop(intensity), 6) as intensity_std, " + ", ".join(f"round(avg({_UNIT.format(c=c)}), 6) as {c}_mean, round(stddev_pop({_UNIT.format(c=c)}), 6) as {c}_std" for c in "rgb") + " from p join m using (cloud_id) group by cloud_id")
def cloud_attributes(t):
    return rounded(C.attributes(derived.embedding_clouds(t("embeddings")).withColumn("cloud_id", F.col("cloud_id").cast("string"))))


@query(f"with {CLOUDS} select cloud_id, count(*)::bigint as n, " + ", ".join(f"round(covar_samp({a}, {b}), 6) as {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " from p group by cloud_id")
def cloud_covariance(t):
    return rounded(C.covariance(clouds(t)))


@query()
def cloud_shape_descriptors(t):
    return rounded(C.shape(clouds(t)))


@query()  # SQL would need all pairs of points; held against brute force in tests/test_whole_arrays.py
def cloud_nearest_neighbours(t):
    return rounded(C.nearest_neighbours(clouds(t)))


@query(f"with {CLOUDS}, e as (select cloud_id, min(x) as xa, max(x) as xb, min(y) as ya, max(y) as yb from p group by 1) select cloud_id, least(floor((x - xa) / ((xb - xa) / 80)), 79)::int as bx, least(floor((y - ya) / ((yb - ya) / 80)), 79)::int as by, count(*)::bigint as count from p join e using (cloud_id) group by all")
def cloud_xy_density(t):
    return C.xy_density(clouds(t))


@query(f"with {CLOUDS}, e as (select cloud_id, min(z) as a, max(z) as b, count(*) as n from p group by 1), h as (select cloud_id, least(floor((z - a) / ((b - a) / 40)), 39)::int as bin, a, (b - a) / 40 as w, n from p join e using (cloud_id)) select cloud_id, bin, round(a + bin * w, 6) as lo, round(a + (bin + 1) * w, 6) as hi, count(*)::bigint as count, round(count(*)::double / n / ((a + (bin + 1) * w) - (a + bin * w)), 6) as density from h group by cloud_id, bin, a, w, n")
def cloud_height_histogram(t):
    return rounded(C.height_histogram(clouds(t)))


@query()
def cloud_records(t):
    return rounded(C.records(coloured_clouds(t)))


@query()
def cloud_pairwise_distance(t):
    rec = C.records(coloured_clouds(t))
    return rounded(distance.euclidean(rec, "cloud_id", C.DISTANCE_METRICS))


IMAGE = f"e0 as (select label as image_id, (row_number() over (partition by label order by vec_id) - 1)::int as y, {_E} as e from embeddings), lv as (select image_id, y, list_transform(e, lambda v: floor(greatest(0, least(1, v)) * 255)::int) as l from e0), px as (select image_id, y, i::int as x, l[i + 1] as r, l[(i + 1) % 64 + 1] as g, l[(i + 2) % 64 + 1] as b from lv, range(64) t(i)), gx as (select *, 0.299::double * r + 0.587::double * g + 0.114::double * b as v from px)"


def images(t):
    return derived.images(t("embeddings"))


@query(f"with {IMAGE} select image_id, " + ", ".join(f"round(avg({c}), 6) as mean_{c}, round(stddev_pop({c}), 6) as std_{c}, min({c})::double as min_{c}, max({c})::double as max_{c}" for c in "rgb") + ", round(avg(v), 6) as brightness, round(stddev_pop(v), 6) as contrast, round(avg((v > 245)::int), 6) as overexposed_frac, round(avg((v < 10)::int), 6) as underexposed_frac from gx group by image_id")
def image_channel_stats(t):
    return rounded(I.channel_stats(images(t)))


@query(f"with {IMAGE}, c as (select image_id, round_even(v, 0) as q, count(*) as n from gx group by all), p as (select image_id, n / sum(n) over (partition by image_id) as p from c) select image_id, round(-sum(p * log2(p)), 6) as entropy_val from p group by image_id")
def image_entropy(t):
    return rounded(I.entropy(images(t)))


_N = "lag(v) over (partition by image_id, x order by y) as u, lead(v) over (partition by image_id, x order by y) as d, lag(v) over (partition by image_id, y order by x) as l, lead(v) over (partition by image_id, y order by x) as rr"


@query(f"with {IMAGE}, q as (select image_id, x, y, round_even(v, 0) as v from gx), n as (select *, {_N} from q), s as (select image_id, var_pop(coalesce(u, d, v) + coalesce(d, u, v) + coalesce(l, rr, v) + coalesce(rr, l, v) - 4 * v) as s from n group by 1) select image_id, round(s, 6) as sharpness, s < 50 as is_blurry from s")
def image_sharpness(t):
    return rounded(I.sharpness(images(t)))


@query(f"with {IMAGE}, n as (select *, {_N} from gx), b as (select image_id, 'y' as k, y as at, avg(abs(v - u)) as d from n where y % 8 = 0 and y > 0 group by all union all select image_id, 'x', x, avg(abs(v - l)) from n where x % 8 = 0 and x > 0 group by all) select image_id, round(avg(d), 6) as blockiness from b group by image_id")
def image_blockiness(t):
    return rounded(I.blockiness(images(t)))


_HSV = "h as (select *, greatest(r, g, b)::double as mx, greatest(r, g, b)::double - least(r, g, b) as dd from px), h2 as (select *, 60.0::double * case when mx = r then (g - b)::double / case when dd > 0 then dd else 1 end when mx = g then 2 + (b - r)::double / case when dd > 0 then dd else 1 end else 4 + (r - g)::double / case when dd > 0 then dd else 1 end end as hh from h)"


@query(f"with {IMAGE}, {_HSV}, s as (select image_id, avg(case when mx > 0 then 255 * dd / mx else 0 end) as sm, avg(mx) as vm, avg(case when dd > 0 then case when hh < 0 then hh + 360 else hh end else 0 end / 2) as hm, avg(r) / (avg(b) + 1e-6) as w from h2 group by 1) select image_id, round(sm, 6) as saturation_mean, round(vm, 6) as value_mean, round(hm, 6) as hue_mean, sm < 15 as is_grayscale_like, case when w > 1.1 then 'warm' when w < 0.9 then 'cool' else 'neutral' end as color_temp from s")
def image_colour(t):
    return rounded(I.colour(images(t)))


@query(f"with {IMAGE}, {_HSV} select least(floor(case when hh < 0 then hh + 360 else hh end / 10), 35)::int as bin, count(*)::bigint as count from h2 where dd > 0 group by 1")
def image_hue_histogram(t):
    return I.hue_histogram(images(t))


@query(f"with {IMAGE}, s as (select image_id, " + ", ".join(f"avg({c}) / 255 as m{c}, stddev_pop({c}) / 255 as s{c}" for c in "rgb") + " from px group by 1) select " + ", ".join(f"round(avg(m{c}), 6) as mean_{c}, round(avg(s{c}), 6) as std_{c}" for c in "rgb") + " from s")
def image_normalization_stats(t):
    return rounded(I.normalization(images(t)))


@query(f"with {IMAGE} select y, x, " + ", ".join(f"round(avg({c}), 6) as mean_{c}, round(stddev_pop({c}), 6) as std_{c}" for c in "rgb") + " from px group by y, x")
def image_average(t):
    return rounded(I.average_image(images(t)))


@query(f"with {IMAGE} select round(corr(r, g), 6) as rg, round(corr(r, b), 6) as rb, round(corr(g, b), 6) as gb from px")
def image_channel_correlation(t):
    return rounded(I.channel_correlation(images(t)))


_GLCM = "q as (select image_id, y, x, floor(v / 4)::int as q from gx), n as (select image_id, q, lag(q) over (partition by image_id, y order by x) as p from q), c as (select image_id, i, j, count(*)::bigint as n from (select image_id, p as i, q as j from n where p is not null union all select image_id, q, p from n where p is not null) group by all)"


@query(f"with {IMAGE}, {_GLCM} select image_id, i, j, n from c")
def image_cooccurrence(t):
    return I.cooccurrence(images(t))


@query(f"with {IMAGE}, {_GLCM}, p as (select *, n / sum(n) over (partition by image_id) as p from c) select image_id, round(sum((i - j) * (i - j) * p), 6) as contrast, round(sum(abs(i - j) * p), 6) as dissimilarity, round(sum(p / (1 + (i - j) * (i - j))), 6) as homogeneity, round(sum(p * p), 6) as asm, round(sqrt(sum(p * p)), 6) as energy from p group by image_id")
def image_texture(t):
    return rounded(I.cooccurrence_measures(images(t)))


@query(f"with {IMAGE} select image_id, md5(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' order by y, x))) as digest from px group by image_id")
def image_digest(t):
    return I.packed(images(t)).select("image_id", F.md5("data").alias("digest"))


@query()
def image_records(t):
    rec = I.records(I.packed(images(t)))
    return rounded(rec.select(*[F.to_json(c).alias(c) if k.startswith("array") else F.col(c) for c, k in rec.dtypes]))


# a hash for each customer; those of one nation, segment and range of balance have the same one
_HASHES = "h as (select c_custkey as id, ('0x' || substr(md5(c_nationkey::varchar || c_mktsegment || floor(c_acctbal / 1000)::int::varchar), 1, 15))::bigint as h from customer)"


def _hashes(t):
    of = F.md5(F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("int").cast("string")))
    return t("customer").select(F.col("c_custkey").alias("id"), F.conv(F.substring(of, 1, 15), 16, 10).cast("long").alias("h"))


@query(f"with {_HASHES} select a.id as id_a, b.id as id_b, bit_count(xor(a.h, b.h))::int as distance from h a join h b on a.id < b.id and bit_count(xor(a.h, b.h)) <= 20")
def hamming_pairs(t):
    return dedup.hamming_pairs(_hashes(t), "id", "h", 20)


@query()
def hamming_groups(t):
    return dedup.hamming_groups(_hashes(t), "id", "h", 18)


@query()
def image_phash_pairs(t):
    rec = I.records(I.packed(images(t)), texture=False)
    return dedup.hamming_pairs(rec.where("not is_corrupt"), "image_id", "phash", 32)


@query()
def image_dominant_colours(t):
    return rounded(I.dominant_colours(images(t)), 4)


VIDEO = f"f0 as (select label as video_id, (row_number() over (partition by label order by vec_id) - 1)::int as frame_idx, {_E} as e from embeddings), vx as (select video_id, frame_idx, (i // 8)::int as y, (i % 8)::int as x, floor(greatest(0, least(1, e[i + 1])) * 255)::int as v from f0, range(64) t(i))"
_PROFILE = "n as (select *, lag(v) over (partition by video_id, y, x order by frame_idx) as before, lag(v) over (partition by video_id, frame_idx, x order by y) as u, lead(v) over (partition by video_id, frame_idx, x order by y) as d, lag(v) over (partition by video_id, frame_idx, y order by x) as l, lead(v) over (partition by video_id, frame_idx, y order by x) as rr from vx), fs as (select video_id, frame_idx, avg(v) as brightness, stddev_pop(v) as contrast, var_pop(coalesce(u, d, v) + coalesce(d, u, v) + coalesce(l, rr, v) + coalesce(rr, l, v) - 4 * v) as sharpness, avg(abs(v - before)) as diff from n group by all)"


def videos(t):
    return derived.videos(t("embeddings"))


@query(f"with {VIDEO}, {_PROFILE} select video_id, frame_idx, {r('brightness', 'contrast', 'sharpness', 'diff')} from fs")
def video_temporal_profile(t):
    return rounded(V.frame_stats(videos(t)))


_MOTION = """q as (select video_id, quantile_cont(diff, 0.75) as p75 from fs group by 1), ms as (select video_id, count(*)::bigint as sampled_frames, avg(brightness) as brightness_mean, stddev_pop(brightness) as brightness_std, avg(contrast) as contrast_mean, stddev_pop(contrast) as contrast_std,
avg(sharpness) as sharpness_mean, stddev_pop(sharpness) as sharpness_std, min(sharpness) as sharpness_min, avg((sharpness < 80)::int) as blur_fraction, coalesce(avg(diff), 0) as motion_intensity_mean, coalesce(stddev_pop(diff), 0) as motion_intensity_std,
count_if(diff > 35)::bigint as scene_change_count, coalesce(count_if(diff > 35)::double / nullif(count(diff), 0), 0) as scene_change_rate, coalesce(count_if(diff > p75 and sharpness < 80)::double / nullif(count(diff), 0), 0) as motion_blur_fraction from fs join q using (video_id) group by video_id)"""
_MOTION_NAMES = ["brightness_mean", "brightness_std", "contrast_mean", "contrast_std", "sharpness_mean", "sharpness_std", "sharpness_min", "blur_fraction", "motion_intensity_mean", "motion_intensity_std", "scene_change_rate", "motion_blur_fraction"]


@query(f"with {VIDEO}, {_PROFILE}, {_MOTION} select video_id, sampled_frames, scene_change_count, {r(*_MOTION_NAMES)} from ms")
def video_motion_summary(t):
    return rounded(V.motion_summary(V.frame_stats(videos(t))))


@query(f"with {VIDEO}, {_PROFILE} select video_id, frame_idx, round(diff, 6) as diff from fs where diff > 10")
def video_scene_changes(t):
    return rounded(V.scene_changes(V.frame_stats(videos(t)), 10.0))


_SHAPE = "sh as (select video_id, (max(frame_idx) + 1)::bigint as n_frames, 30.0::double as fps, (max(frame_idx) + 1) / 30.0 as duration_sec, (max(y) + 1)::bigint as height, (max(x) + 1)::bigint as width from {src} group by 1)"


@query(f"with {VIDEO}, {_PROFILE}, {_MOTION}, {_SHAPE.format(src='vx')} select video_id, n_frames, fps, round(duration_sec::double, 6) as duration_sec, height, width, round(width::double / height, 6) as aspect_ratio, round(height * width / 1e6::double, 6) as megapixels, sampled_frames, scene_change_count, {r(*_MOTION_NAMES)} from ms join sh using (video_id)")
def video_records(t):
    return rounded(V.records(videos(t)))


_Z = ", ".join(f"(coalesce({m}, 0)::double - avg(coalesce({m}, 0)::double) over ()) / case when stddev_pop(coalesce({m}, 0)::double) over () = 0 then 1 else stddev_pop(coalesce({m}, 0)::double) over () end as z{i}" for i, m in enumerate(V.DISTANCE_METRICS))
_ZD = " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(len(V.DISTANCE_METRICS)))


@query(f"with {VIDEO}, {_PROFILE}, {_MOTION}, {_SHAPE.format(src='vx')}, z as (select video_id, {_Z} from ms join sh using (video_id)) select a.video_id as id_a, b.video_id as id_b, round(sqrt({_ZD}), 6) as distance from z a join z b on a.video_id < b.video_id")
def video_pairwise_distance(t):
    return rounded(distance.euclidean(V.records(videos(t)), "video_id", V.DISTANCE_METRICS))


@query("select label, count(*)::bigint as count from embeddings group by label")
def array_label_distribution(t):
    return stats.frequency(t("embeddings"), "label")
