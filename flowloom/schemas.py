"""Table schemas shared by sources and operators."""

from pyspark.sql import types as T

CAPTURES = T.StructType(
    [
        T.StructField("capture_id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("label_id", T.LongType()),
        T.StructField("page_type", T.StringType()),
    ]
)

PACKETS = T.StructType(
    [
        T.StructField("capture_id", T.LongType()),
        T.StructField("pkt_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("src_ip", T.BinaryType()),
        T.StructField("dst_ip", T.BinaryType()),
        T.StructField("src_ip_text", T.StringType()),
        T.StructField("dst_ip_text", T.StringType()),
        T.StructField("sport", T.IntegerType()),
        T.StructField("dport", T.IntegerType()),
        T.StructField("proto", T.IntegerType()),
        T.StructField("frame_len", T.IntegerType()),
        T.StructField("payload_len", T.IntegerType()),
        T.StructField("ip_header", T.BinaryType()),
        T.StructField("l4_header", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        # why reading the capture stopped, on its cut last packet or on a row without one
        T.StructField("error", T.StringType()),
    ]
)
