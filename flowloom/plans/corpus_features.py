"""Captures to labelled feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.text import safe_label
from flowloom.operators import features as X
from flowloom.operators import labels as L
from flowloom.operators.flows import FLOW_KEY, flow_id, key_flows, select_packets
from flowloom.operators.funnel import flow_funnel, without_flows
from flowloom.profiles import IMAGE_PAYLOAD, UNIFIED, FlowProfile
from flowloom.session import staged
from flowloom.sources.captures import large_enough
from flowloom.sources.decode import capture_errors, read_packets

FAMILIES = {
    "lengths": X.length_sequences,
    "directions": X.direction_sequences,
    "statistics": X.flow_statistics,
    "images": X.flow_images,
}
# Packet columns each family needs; the rest is dropped before the shuffle.
_KEY_INPUT = ["capture_id", "pkt_no", "src_ip", "dst_ip", "src_ip_text", "dst_ip_text", "sport", "dport", "proto"]
_NEEDS = {
    "lengths": ["frame_len"],
    "directions": [],
    "statistics": ["frame_len"],
    "images": ["ip_header", "l4_header", "payload"],
}


def family_features(packets: DataFrame, family: str, profile: FlowProfile = UNIFIED) -> DataFrame:
    """One feature family for all flows of a packet table."""
    kept = select_packets(packets, profile)
    time = ["ts"] if profile.time_ordered else []
    slim = kept.select(*_KEY_INPUT, *time, *_NEEDS[family])
    return FAMILIES[family](key_flows(slim, profile), profile)


def labelled_features(
    packets: DataFrame,
    captures: DataFrame,
    family: str,
    profile: FlowProfile = UNIFIED,
    min_samples: int = 10,
) -> DataFrame:
    """Feature rows with class name and dense class id; small classes are dropped.

    ``captures`` carries ``label`` per capture. ``page_type``, if it is there, and the
    stored order of the flows, (``capture_path``, ``first_pkt``), are carried along, so
    that the rows can enter the sequential splits and experiments. Class sizes come from
    a staged copy of the features, so the packets are read once.
    """
    flows = family_features(packets, family, profile)
    keyed = key_flows(select_packets(packets, profile).select(*_KEY_INPUT), profile)
    starts = keyed.groupBy(*FLOW_KEY).agg(F.min("pkt_no").alias("first_pkt"))
    known = {"label": "label", "page_type": "page_type", "path": "capture_path"}
    described = captures.select(
        "capture_id", *[F.col(c).alias(n) for c, n in known.items() if c in captures.columns]
    )
    carried = [c for c in ("page_type", "capture_path") if c in described.columns]
    named = flows.join(starts, FLOW_KEY).join(described, "capture_id").select(
        flow_id().alias("sample_id"),
        safe_label(F.col("label")).alias("label"),
        *carried,
        "first_pkt",
        *[c for c in flows.columns if c not in FLOW_KEY],
    )
    samples = staged(named, f"features-{family}")
    return L.drop_small_classes(L.encode_labels(samples), min_samples)


@dataclass(frozen=True)
class CorpusFeatures:
    """What one reading of a corpus gives."""

    families: dict[str, DataFrame]
    errors: DataFrame  # capture_id, pkt_no, error: captures that were not read to their end
    funnel: DataFrame  # packets and flows per capture by stage
    failed: DataFrame  # captures without a flow


def corpus_families(
    captures: DataFrame,
    families: Sequence[str] = tuple(FAMILIES),
    profile: FlowProfile = UNIFIED,
    link: str = "probe",
    min_samples: int = 10,
    completed: DataFrame | None = None,
    min_packets: int = 1,
) -> CorpusFeatures:
    """Capture files to labelled features of several families, from one reading.

    ``captures`` has capture_id, path, length and label, and may have page_type. Labels
    listed in ``completed`` are skipped, so that a run can be resumed. Decoded packets
    are staged as a table: every family then reads only the columns and rows it needs,
    and a lost executor does not cause captures to be decoded again. Images need no more
    of a payload than they hold, so no more is staged.
    """
    todo = large_enough(captures, profile.min_bytes)
    if completed is not None:
        todo = L.not_completed(todo, completed)
    # a file listing counts as large as the files it lists; the staged table does not
    wanted = [c for c in ("capture_id", "path", "length", "label", "page_type") if c in todo.columns]
    todo = staged(todo.select(*wanted), "captures")
    read = read_packets(todo, link, with_bytes="images" in families, payload_bytes=IMAGE_PAYLOAD)
    packets = staged(read, "packets")
    keyed = key_flows(select_packets(packets, profile).select(*_KEY_INPUT), profile)
    return CorpusFeatures(
        {f: labelled_features(packets, todo, f, profile, min_samples) for f in families},
        capture_errors(packets),
        flow_funnel(packets.filter("frame_len IS NOT NULL"), profile, min_packets),
        without_flows(todo, keyed),
    )


def corpus_features(
    captures: DataFrame,
    family: str,
    profile: FlowProfile = UNIFIED,
    link: str = "probe",
    min_samples: int = 10,
    completed: DataFrame | None = None,
) -> DataFrame:
    """One family of `corpus_families`."""
    return corpus_families(captures, [family], profile, link, min_samples, completed).families[family]
