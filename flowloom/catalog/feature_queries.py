"""Statistics vectors, sequences, tokens and byte images per flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.registry import big, flow_key_id, query, r6
from flowloom.functions import images as I
from flowloom.functions import sequences as S
from flowloom.functions import stats
from flowloom.operators import features as X
from flowloom.operators import flows, scaling, splits
from flowloom.profiles import (
    PROCESSOR_DIRECTIONS,
    PROCESSOR_LENGTHS,
    PROCESSOR_STATS,
    UNIFIED,
    UNIFIED_PROPORTIONAL,
)

U = ("flow_packets",)
C = ("client_packets",)


def _block_sql(d: str, kurt_min: int, guard: str = "") -> str:
    """18 statistics of one direction in SQL; `x_<d>` is the length or null."""
    x, m, med = f"x_{d}", f"m_{d}", f"med_{d}"
    n = f"count({x})"
    parts = [
        f"CAST({n} AS DOUBLE) AS {d}_count",
        f"CAST(coalesce(min({x}), 0) AS DOUBLE) AS {d}_min",
        f"CAST(coalesce(max({x}), 0) AS DOUBLE) AS {d}_max",
        f"round(coalesce(avg({x}), 0), 6) + 0.0 AS {d}_mean",
        f"round(coalesce(stddev_pop({x}), 0), 6) + 0.0 AS {d}_std",
        f"round(coalesce(var_pop({x}), 0), 6) + 0.0 AS {d}_var",
        f"round(CASE WHEN {n} >= 3 AND var_pop({x}) > 0 THEN avg(power({x} - {m}, 3)) / power(avg(power({x} - {m}, 2)), 1.5) ELSE 0 END, 6) + 0.0 AS {d}_skew",
        f"round(CASE WHEN {n} >= {kurt_min} AND var_pop({x}) > 0 THEN avg(power({x} - {m}, 4)) / power(avg(power({x} - {m}, 2)), 2) - 3 ELSE 0 END, 6) + 0.0 AS {d}_kurt",
        f"round(coalesce(median(abs({x} - {med})), 0), 6) + 0.0 AS {d}_mad",
    ]
    parts += [
        f"round(coalesce(quantile_cont({x}, {p / 100}), 0), 6) + 0.0 AS {d}_p{p}" for p in X.DECILES
    ]
    return ", ".join(parts)


def stats54_sql(cut: str, outgoing: int, kurt_min: int) -> str:
    """54 columns over the rows of ``cut`` (flow_id, dir, frame_len)."""
    centres = ", ".join(
        f"avg(x_{d}) OVER (PARTITION BY flow_id) AS m_{d}, median(x_{d}) OVER (PARTITION BY flow_id) AS med_{d}"
        for d in X.DIRECTIONS
    )
    blocks = ", ".join(_block_sql(d, kurt_min) for d in X.DIRECTIONS)
    return f"""SELECT flow_id, {blocks} FROM (SELECT *, {centres} FROM (
 SELECT flow_id, CASE WHEN dir = {-outgoing} THEN CAST(frame_len AS DOUBLE) END AS x_in,
  CASE WHEN dir = {outgoing} THEN CAST(frame_len AS DOUBLE) END AS x_out, CAST(frame_len AS DOUBLE) AS x_bi
 FROM ({cut}) c) x) y GROUP BY flow_id"""


_FIRST = """SELECT flow_id, dir, frame_len FROM (SELECT *, count(*) OVER (PARTITION BY flow_id) AS total FROM flow_packets) t
WHERE total >= 7 AND pkt_seq <= {n}"""
_SHARE = """SELECT flow_id, dir, frame_len FROM (
 SELECT *, row_number() OVER (PARTITION BY flow_id, dir ORDER BY pkt_id) AS dir_seq,
  count(*) OVER (PARTITION BY flow_id) AS total,
  sum(CASE WHEN dir = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id) AS outs FROM flow_packets) t
WHERE total >= 7 AND (total <= {n} OR dir_seq <=
 CASE WHEN dir = 1 THEN floor({n} * (CAST(outs AS DOUBLE) / total)) ELSE {n} - floor({n} * (CAST(outs AS DOUBLE) / total)) END)"""
_CLIENT = """SELECT flow_id, -out_sign AS dir, frame_len FROM (SELECT *, count(*) OVER (PARTITION BY flow_id) AS total FROM client_packets) t
WHERE total >= 7 AND pkt_seq <= 260"""


def _vector(df):
    rounded = [f"round({c}, 6) + 0.0D AS {c}" for c in X.FEATURE_NAMES]
    return df.withColumn("flow_id", flow_key_id()).selectExpr("flow_id", *rounded)


@query("g10_stats54_unified", stats54_sql(_FIRST.format(n=260), 1, 4), U)
def _(q):
    return _vector(X.flow_statistics(q.keyed(), UNIFIED))


@query("g10_stats54_first40", stats54_sql(_FIRST.format(n=40), 1, 4), U)
def _(q):
    return _vector(X.flow_statistics(q.keyed(), UNIFIED, max_packets=40))


@query("g10_stats54_proportional40", stats54_sql(_SHARE.format(n=40), 1, 4), U)
def _(q):
    return _vector(X.flow_statistics(q.keyed(), UNIFIED_PROPORTIONAL, max_packets=40))


@query("g10_stats54_processor", stats54_sql(_CLIENT, -1, 3), C)
def _(q):
    return _vector(X.flow_statistics(q.keyed(PROCESSOR_STATS), PROCESSOR_STATS))


# flows of any length: all packets, and cuts that no array of packets would hold
@query("g10_stats54_whole_flows", stats54_sql(_FIRST.format(n=10**9), 1, 4), U)
def _(q):
    return _vector(X.flow_statistics(q.keyed(), UNIFIED, max_packets=None))


@query("g10_stats54_first_million", stats54_sql(_FIRST.format(n=10**6), 1, 4), U)
def _(q):
    return _vector(X.flow_statistics(q.keyed(), UNIFIED, max_packets=10**6))


@query("g10_stats54_proportional_million", stats54_sql(_SHARE.format(n=10**6), 1, 4), U)
def _(q):
    return _vector(X.flow_statistics(q.keyed(), UNIFIED_PROPORTIONAL, max_packets=10**6))


@query("g10_stats54_processor_million", stats54_sql(_CLIENT.replace("260", "1000000"), -1, 3), C)
def _(q):
    return _vector(X.flow_statistics(q.keyed(PROCESSOR_STATS), PROCESSOR_STATS, max_packets=10**6))


def _one_direction(columns):
    """Some statistics of the both-directions block, as their own query."""

    def run(q):
        wide = X.flow_statistics(q.keyed(), UNIFIED)
        return wide.select(flow_key_id(), *[r6(F.col(f"bi_{c}")).alias(c) for c in columns])

    return run


def _one_direction_sql(columns):
    picked = ", ".join(f"bi_{c} AS {c}" for c in columns)
    return f"SELECT flow_id, {picked} FROM ({stats54_sql(_FIRST.format(n=260), 1, 4)}) w"


for _name, _columns in {
    "g5_skewness": ["skew"],
    "g6_kurtosis": ["kurt"],
    "g7_median_absolute_deviation": ["mad"],
    "g8_percentiles": [f"p{p}" for p in X.DECILES],
    "g9_stats18": X.BLOCK_STATS,
}.items():
    query(_name, _one_direction_sql(_columns), U)(_one_direction(_columns))


_LENGTHS_SQL = """SELECT flow_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pkt_seq) AS seq FROM sequences GROUP BY flow_id"""


def _lengths(q):
    return X.length_sequences(q.keyed(), UNIFIED).withColumn("lengths", F.col("lengths").cast("array<int>"))


def _text(df, column):
    return df.select(flow_key_id(), S.joined(column).alias("seq"))


@query("a1_length_sequences", _LENGTHS_SQL, ("sequences",))
def _(q):
    return _text(_lengths(q), F.col("lengths"))


@query(
    "a1_length_sequences_client",
    """SELECT flow_id, string_agg(CAST(out_sign * least(frame_len, 1500) AS VARCHAR), ',' ORDER BY pkt_seq) AS seq
FROM client_packets WHERE pkt_seq <= 100 GROUP BY flow_id HAVING count(*) >= 10""",
    C,
)
def _(q):
    return _text(X.length_sequences(q.keyed(PROCESSOR_LENGTHS), PROCESSOR_LENGTHS), F.col("lengths"))


_DIRECTIONS_SQL = """SELECT flow_id, string_agg(CAST({v} AS VARCHAR), ',' ORDER BY pkt_seq) AS seq
FROM {t} WHERE pkt_seq <= {n} GROUP BY flow_id HAVING count(*) >= {k}"""


@query("a2_direction_sequences", _DIRECTIONS_SQL.format(v="dir", t="flow_packets", n=5000, k=50), U)
def _(q):
    return _text(X.direction_sequences(q.keyed(), UNIFIED), F.col("directions"))


@query("a2_direction_sequences_first40", _DIRECTIONS_SQL.format(v="dir", t="flow_packets", n=40, k=20), U)
def _(q):
    return _text(X.direction_sequences(q.keyed(), UNIFIED, 20, 40), F.col("directions"))


@query(
    "a2_direction_sequences_client",
    """WITH kept AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY ts, pkt_id) AS k,
 first_value(src_ip_text) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id) AS first_src
 FROM client_packets WHERE payload_len > 0 AND NOT (proto = 17 AND (sport = 5353 OR dport = 5353)))
SELECT flow_id, string_agg(CASE WHEN src_ip_text = first_src THEN '1' ELSE '-1' END, ',' ORDER BY k) AS seq
FROM kept WHERE k <= 40 GROUP BY flow_id HAVING count(*) >= 20""",
    C,
)
def _(q):
    keyed = q.keyed(PROCESSOR_DIRECTIONS)
    return _text(X.direction_sequences(keyed, PROCESSOR_DIRECTIONS, 20, 40), F.col("directions"))


@query(
    "a3_direction_length_pairs",
    """SELECT flow_id, CAST(pkt_seq AS BIGINT) AS pkt_seq, CAST(dir AS BIGINT) AS dir, frame_len FROM
 (SELECT *, count(*) OVER (PARTITION BY flow_id) AS total FROM flow_packets) t WHERE pkt_seq <= 260 AND total >= 7""",
    U,
)
def _(q):
    cut = X.stats_packets(q.keyed(), UNIFIED)
    return cut.select(flow_key_id(), *big("pkt_seq", "dir", "frame_len"))


def _tokens_sql(expression):
    return f"""SELECT flow_id, string_agg(CAST({expression} AS VARCHAR), ',' ORDER BY pkt_seq) AS seq
FROM sequences GROUP BY flow_id"""


@query("a4_shifted_tokens", _tokens_sql("v + 1501"), ("sequences",))
def _(q):
    return _text(_lengths(q), S.shift_tokens(F.col("lengths")))


@query("a5_shifted_tokens_zero_padding", _tokens_sql("CASE WHEN v = 0 THEN 0 ELSE v + 1501 END"), ("sequences",))
def _(q):
    return _text(_lengths(q), S.shift_tokens_keep_zero(F.col("lengths")))


@query("a6_unsigned_tokens", _tokens_sql("least(abs(v), 1000)"), ("sequences",))
def _(q):
    return _text(_lengths(q), S.unsigned_tokens(F.col("lengths"), 1000))


@query(
    "a6_unsigned_tokens_min_length",
    """SELECT flow_id, concat(string_agg(CAST(least(abs(v), 1500) AS VARCHAR), ',' ORDER BY pkt_seq),
 repeat(',0', CAST(greatest(20 - count(*), 0) AS INT))) AS seq FROM sequences GROUP BY flow_id""",
    ("sequences",),
)
def _(q):
    return _text(_lengths(q), S.unsigned_tokens(F.col("lengths"), 1500, 20))


@query("a7_folded_tokens", _tokens_sql("CASE WHEN v < 0 THEN -v ELSE v + 1501 END"), ("sequences",))
def _(q):
    return _text(_lengths(q), S.folded_tokens(F.col("lengths")))


@query(
    "a8_fixed_length",
    """SELECT flow_id, concat(string_agg(CAST(v AS VARCHAR), ',' ORDER BY pkt_seq),
 repeat(',0', CAST(greatest(30 - count(*), 0) AS INT))) AS seq FROM sequences WHERE pkt_seq <= 30 GROUP BY flow_id""",
    ("sequences",),
)
def _(q):
    return _text(_lengths(q), S.fixed_length(F.col("lengths"), 30))


@query(
    "a9_batch_padding",
    """WITH whole AS (SELECT flow_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pkt_seq) AS seq, count(*) AS n FROM sequences GROUP BY flow_id),
batched AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY md5(concat('42:', flow_id)), flow_id) - 1) / 32) AS BIGINT) AS batch_id FROM whole)
SELECT flow_id, batch_id, n AS true_length, concat(seq, repeat(',0', CAST(max(n) OVER (PARTITION BY batch_id) - n AS INT))) AS seq FROM batched""",
    ("sequences",),
)
def _(q):
    rows = _lengths(q).select(flow_key_id(), "lengths")
    batched = splits.batch_ids(rows, 32, row_id="flow_id")
    padded = X.pad_batches(batched, "lengths", "batch_id")
    return padded.select("flow_id", *big("batch_id", "true_length"), S.joined(F.col("lengths")).alias("seq"))


@query("a10_directions_from_lengths", _tokens_sql("sign(v)"), ("sequences",))
def _(q):
    return _text(_lengths(q), S.directions(F.col("lengths")))


_SEQ = ("sequences",)


@query(
    "g14_sequence_length_statistics",
    """SELECT min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std
FROM (SELECT count(*) AS n FROM sequences GROUP BY flow_id) t""",
    _SEQ,
)
def _(q):
    s = scaling.sequence_length_statistics(_lengths(q), "lengths")
    return s.select(*big("min", "max"), r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "g15_absolute_length_statistics",
    """SELECT CAST(min(abs(v)) AS BIGINT) AS min, CAST(max(abs(v)) AS BIGINT) AS max, round(avg(abs(v)), 6) AS mean, round(stddev_pop(abs(v)), 6) AS std FROM sequences""",
    _SEQ,
)
def _(q):
    s = scaling.absolute_length_statistics(_lengths(q), "lengths")
    return s.select(*big("min", "max"), r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "g16_direction_distribution",
    """SELECT count(*) FILTER (WHERE v > 0) AS outgoing, count(*) FILTER (WHERE v < 0) AS incoming, count(*) AS total,
 round(100.0::DOUBLE * count(*) FILTER (WHERE v > 0) / count(*), 6) AS outgoing_pct,
 round(100.0::DOUBLE * count(*) FILTER (WHERE v < 0) / count(*), 6) AS incoming_pct FROM sequences""",
    _SEQ,
)
def _(q):
    signs = _lengths(q).withColumn("signs", S.directions(F.col("lengths")))
    s = scaling.direction_statistics(signs, "signs")
    return s.select(
        *big("outgoing", "incoming", "total"),
        r6("outgoing_pct").alias("outgoing_pct"),
        r6("incoming_pct").alias("incoming_pct"),
    )


# --- byte images, as hex text so that both engines can show them ---


def _hex_packets(q):
    """First five packets of flows with at least five, with made-up header and payload text."""
    cut = X.at_least(flows.first_packets(q.keyed(), UNIFIED, 5), flows.FLOW_KEY, 5)
    number = F.col("pkt_no").cast("string")
    return cut.select(
        flow_key_id(),
        "pkt_seq",
        F.concat(F.md5(number), F.md5(F.concat(F.lit("h"), number))).alias("header_hex"),
        F.repeat(
            F.md5(F.concat(F.lit("p"), number)), (F.col("payload_len") % 20 + 1).cast("int")
        ).alias("payload_hex"),
    )


_BLOCK_SQL = "concat(rpad(header_hex, 160, '0'), rpad(payload_hex, 480, '0'))"
_IMAGE_SQL = f"SELECT flow_id, string_agg({_BLOCK_SQL}, '' ORDER BY pkt_seq) AS image_hex FROM packet_hex GROUP BY flow_id"
H = ("packet_hex",)


def _images(q):
    block = I.packet_block_hex(F.col("header_hex"), F.col("payload_hex"))
    return X.hex_images(_hex_packets(q), ["flow_id"], block)


def _hex_text(patches):
    return F.lower(F.array_join(F.transform(patches, F.hex), ""))


@query("a11_packet_blocks", f"SELECT flow_id, CAST(pkt_seq AS BIGINT) AS pkt_seq, {_BLOCK_SQL} AS block_hex FROM packet_hex", H)
def _(q):
    block = I.packet_block_hex(F.col("header_hex"), F.col("payload_hex"))
    return _hex_packets(q).select("flow_id", *big("pkt_seq"), block.alias("block_hex"))


@query("a11_packet_blocks_binary", f"SELECT flow_id, CAST(pkt_seq AS BIGINT) AS pkt_seq, {_BLOCK_SQL} AS block_hex FROM packet_hex", H)
def _(q):
    header, payload = F.unhex("header_hex"), F.unhex("payload_hex")
    block = I.packet_block(F.substring(header, 1, 20), F.substring(header, 21, 12), payload)
    return _hex_packets(q).select("flow_id", *big("pkt_seq"), F.lower(F.hex(block)).alias("block_hex"))


@query("a12_flow_images", _IMAGE_SQL, H)
def _(q):
    return _images(q)


@query("a12_flow_images_binary", _IMAGE_SQL, H)
def _(q):
    number = F.col("pkt_no").cast("string")
    header = F.unhex(F.concat(F.md5(number), F.md5(F.concat(F.lit("h"), number))))
    payload = F.unhex(
        F.repeat(F.md5(F.concat(F.lit("p"), number)), (F.col("payload_len") % 20 + 1).cast("int"))
    )
    keyed = (
        q.keyed()
        .withColumn("ip_header", F.substring(header, 1, 20))
        .withColumn("l4_header", F.substring(header, 21, 12))
        .withColumn("payload", payload)
    )
    image = X.flow_images(keyed, UNIFIED)
    return image.select(flow_key_id(), F.lower(F.hex("image")).alias("image_hex"))


@query(
    "a13_capture_image_text_strip",
    """SELECT flow_id, string_agg(concat(rpad(left(replace(concat(header_hex, payload_hex), payload_hex, ''), 160), 160, '0'),
 rpad(left(payload_hex, 480), 480, '0')), '' ORDER BY pkt_seq) AS image_hex FROM packet_hex GROUP BY flow_id""",
    H,
)
def _(q):
    whole = F.concat("header_hex", "payload_hex")
    block = I.stripped_block_hex(whole, F.col("payload_hex"))
    return X.hex_images(_hex_packets(q), ["flow_id"], block)


@query(
    "a14_image_from_packet_text",
    """SELECT flow_id, string_agg(rpad(left(concat(header_hex, payload_hex), 640), 640, '0'), '' ORDER BY pkt_seq) AS image_hex
FROM packet_hex GROUP BY flow_id""",
    H,
)
def _(q):
    block = I.frame_block_hex(F.concat("header_hex", "payload_hex"))
    return X.hex_images(_hex_packets(q), ["flow_id"], block)


@query(
    "a15_scaled_pixels",
    f"""SELECT flow_id, round(list_sum(list_transform(range(0, 1600), lambda i: (list_position(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], substr(image_hex, 2 * i + 1, 1)) - 1) * 16
  + list_position(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], substr(image_hex, 2 * i + 2, 1)) - 1)) / 255.0::DOUBLE, 6) AS total,
 round((strpos('0123456789abcdef', substr(image_hex, 1, 1)) * 16 + strpos('0123456789abcdef', substr(image_hex, 2, 1)) - 17) / 255.0::DOUBLE, 6) AS first_pixel
FROM ({_IMAGE_SQL}) i""",
    H,
)
def _(q):
    scaled = _images(q).withColumn("pixels", I.scaled_pixels(F.unhex("image_hex")))
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)
    return scaled.select(
        "flow_id", r6(total).alias("total"), r6(F.get("pixels", F.lit(0))).alias("first_pixel")
    )


_PATCH_SQL = """list_transform(range(0, 400), lambda i: concat(
 substr(image_hex, ((i // 20) * 80 + (i % 20) * 2) * 2 + 1, 4), substr(image_hex, ((i // 20) * 80 + 40 + (i % 20) * 2) * 2 + 1, 4)))"""


@query(
    "a16_patches",
    f"SELECT flow_id, array_to_string({_PATCH_SQL}, '') AS patches FROM ({_IMAGE_SQL}) i",
    H,
)
def _(q):
    return _images(q).select(
        "flow_id", _hex_text(I.patches(F.unhex("image_hex"))).alias("patches")
    )


@query("a16_patches_inverse", _IMAGE_SQL, H)
def _(q):
    split = _images(q).withColumn("patches", I.patches(F.unhex("image_hex")))
    image = I.image_from_patches(F.col("patches"))
    return split.select("flow_id", F.lower(F.hex(image)).alias("image_hex"))


@query(
    "a17_random_patch_mask",
    f"""WITH images AS ({_IMAGE_SQL}),
ranks AS (SELECT flow_id, i, row_number() OVER (PARTITION BY flow_id ORDER BY md5(concat('7:', flow_id, ':', CAST(i AS VARCHAR))), i) - 1 AS r
 FROM images, range(0, 400) AS g(i)),
masks AS (SELECT flow_id, string_agg(CASE WHEN r < 39 THEN '0' ELSE '1' END, '' ORDER BY i) AS mask,
 string_agg(CAST(r AS VARCHAR), ',' ORDER BY i) AS restore_order,
 string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r < 39) AS kept FROM ranks GROUP BY flow_id)
SELECT * FROM masks""",
    H,
)
def _(q):
    shuffled = _images(q).withColumn("ids", I.shuffled_patch_ids(F.col("flow_id"), 7))
    placed = shuffled.withColumn("restore", I.restore_order(F.col("ids")))
    mask = F.transform(I.patch_mask(F.col("restore"), 0.9), lambda v: v.cast("string"))
    return placed.select(
        "flow_id",
        F.array_join(mask, "").alias("mask"),
        S.joined(F.col("restore")).alias("restore_order"),
        S.joined(F.slice("ids", 1, I.kept_patches(0.9))).alias("kept"),
    )


@query(
    "a17_visible_patches",
    f"""WITH images AS ({_IMAGE_SQL}),
cells AS (SELECT flow_id, unnest({_PATCH_SQL}) AS patch, unnest(range(0, 400)) AS i FROM images),
ranks AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY md5(concat('7:', flow_id, ':', CAST(i AS VARCHAR))), i) AS r FROM cells)
SELECT flow_id, string_agg(patch, '' ORDER BY r) AS visible FROM ranks WHERE r <= 100 GROUP BY flow_id""",
    H,
)
def _(q):
    rows = _images(q)
    visible = I.visible_patches(
        I.patches(F.unhex("image_hex")), I.shuffled_patch_ids(F.col("flow_id"), 7), 0.75
    )
    return rows.select("flow_id", _hex_text(visible).alias("visible"))


# --- numeric matrix ---

_COLUMNS = ["f0", "f1", "f2", "f3", "f4"]
_F = ("features",)
_CLEAN = "SELECT sample_id, label, domain, CASE WHEN isnan(f0) OR isinf(f0) THEN 0 ELSE f0 END AS f0, f1, f2, f3, f4 FROM features"


@query("p18_clean_values", f"SELECT sample_id, f0 FROM ({_CLEAN}) c", _F)
def _(q):
    return q.features().select("sample_id", stats.finite_or_zero(F.col("f0")).alias("f0"))


@query(
    "p18_bad_value_counts",
    "SELECT count(*) FILTER (WHERE isnan(f0)) AS nan_count, count(*) FILTER (WHERE isinf(f0)) AS inf_count FROM features",
    _F,
)
def _(q):
    return scaling.bad_values(q.features(), _COLUMNS).select(*big("nan_count", "inf_count"))


@query(
    "g17_matrix_statistics",
    f"""SELECT round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
FROM (SELECT unnest([f0, f1, f2, f3, f4]) AS x FROM ({_CLEAN}) c) t""",
    _F,
)
def _(q):
    s = scaling.matrix_statistics(scaling.clean(q.features(), _COLUMNS), _COLUMNS)
    return s.select(*[r6(c).alias(c) for c in ("min", "max", "mean", "std")])


def _scaler_sql(std):
    return ", ".join(
        f"round(avg({c}), 6) + 0.0 AS {c}_mean, round({std.format(c=c)}, 6) + 0.0 AS {c}_std" for c in _COLUMNS
    )


_STD1 = "CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END"


def _rounded(df):
    return df.select(
        *[r6(c).alias(c) if c.startswith("f") else F.col(c).cast("bigint").alias(c) for c in df.columns]
    )


@query("g18_scaler_zero_to_one", f"SELECT {_scaler_sql(_STD1)} FROM ({_CLEAN}) c", _F)
def _(q):
    return _rounded(scaling.fit_scaler(scaling.clean(q.features(), _COLUMNS), _COLUMNS))


@query("g19_scaler_epsilon", f"SELECT {_scaler_sql('stddev_pop({c}) + 1e-8')} FROM ({_CLEAN}) c", _F)
def _(q):
    return _rounded(scaling.fit_scaler(scaling.clean(q.features(), _COLUMNS), _COLUMNS, epsilon=1e-8))


def _z_sql(partition):
    return ", ".join(
        f"round(({c} - avg({c}) OVER ({partition})) / CASE WHEN stddev_pop({c}) OVER ({partition}) = 0 THEN 1 ELSE stddev_pop({c}) OVER ({partition}) END, 6) + 0.0 AS {c}"
        for c in _COLUMNS
    )


@query("j8_apply_scaler_row", f"SELECT sample_id, {_z_sql('')} FROM ({_CLEAN}) c", _F)
def _(q):
    rows = scaling.clean(q.features(), _COLUMNS)
    scaled = scaling.apply_scaler(rows, scaling.fit_scaler(rows, _COLUMNS), _COLUMNS)
    return scaled.select("sample_id", *[r6(c).alias(c) for c in _COLUMNS])


def _two_domains(q):
    split = F.when(F.col("domain") == 0, "train").otherwise("test")
    return scaling.clean(q.features(), _COLUMNS).withColumn("split", split)


@query(
    "a18_z_score_train_parameters",
    "SELECT sample_id, "
    + ", ".join(
        f"round(({c} - p.{c}_m) / CASE WHEN p.{c}_s = 0 THEN 1 ELSE p.{c}_s END, 6) + 0.0 AS {c}" for c in _COLUMNS
    )
    + f" FROM ({_CLEAN}) c, (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _COLUMNS)
    + f" FROM ({_CLEAN}) t WHERE domain = 0) p",
    _F,
)
def _(q):
    scaled = scaling.scale_splits(_two_domains(q), _COLUMNS)
    return scaled.select("sample_id", *[r6(c).alias(c) for c in _COLUMNS])


@query("a19_z_score_own_test_parameters", f"SELECT sample_id, {_z_sql('PARTITION BY domain')} FROM ({_CLEAN}) c", _F)
def _(q):
    scaled = scaling.scale_splits(_two_domains(q), _COLUMNS, own_test=True)
    return scaled.select("sample_id", *[r6(c).alias(c) for c in _COLUMNS])


@query("a19_z_score_per_domain", f"SELECT sample_id, {_z_sql('PARTITION BY domain')} FROM ({_CLEAN}) c", _F)
def _(q):
    rows = scaling.clean(q.features(), _COLUMNS)
    params = scaling.fit_scaler(rows, _COLUMNS, ["domain"])
    scaled = scaling.apply_scaler(rows, params, _COLUMNS, ["domain"])
    return scaled.select("sample_id", *[r6(c).alias(c) for c in _COLUMNS])
