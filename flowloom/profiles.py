"""Flow conventions.

Two families of rules exist for turning packets into flows, and they give
different features. A ``FlowProfile`` states one of them completely.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
TCP = 6
UDP = 17
MDNS_PORT = 5353
MULTICAST_ADDRESSES = ("224.0.0.251", "ff02::fb", "ff05::fb")
MIN_CAPTURE_BYTES = 20 * 1024
MTU = 1500
LENGTHS_MIN, LENGTHS_MAX = 10, 100
DIRECTIONS_MIN, DIRECTIONS_MAX = 50, 5000
STATS_MIN, STATS_MAX = 7, 260
IMAGE_PACKETS, IMAGE_HEADER, IMAGE_PAYLOAD, IMAGE_SIDE = 5, 80, 240, 40


@dataclass(frozen=True)
class FlowProfile:
    """Rules for one way of building flows.

    key_order      "numeric" compares addresses as numbers (binary columns),
                   "text" compares their text form
    direction      "canonical": sign by key order; "client": sign by whether the
                   sender also sent the first packet of the flow
    outgoing       value given to the canonical / client direction
    time_ordered   order packets by timestamp (ties by position) instead of position
    payload_only   keep only packets that carry payload
    drop_udp_ports UDP ports whose packets are dropped
    drop_addresses addresses (text form) whose packets are dropped
    ip_versions    accepted IP versions
    min_bytes      smallest capture file that is read
    proportional   over-long flows keep their in/out ratio instead of the first packets
    kurtosis_min_n smallest sample for excess kurtosis
    """

    name: str
    key_order: str = "numeric"
    direction: str = "canonical"
    outgoing: int = 1
    time_ordered: bool = False
    payload_only: bool = False
    drop_udp_ports: tuple[int, ...] = ()
    drop_addresses: tuple[str, ...] = ()
    ip_versions: tuple[int, ...] = (4, 6)
    min_bytes: int = 0
    proportional: bool = False
    kurtosis_min_n: int = 4

    def __post_init__(self):
        if self.key_order not in ("numeric", "text"):
            raise ValueError(f"unknown key order: {self.key_order}")
        if self.direction not in ("canonical", "client"):
            raise ValueError(f"unknown direction rule: {self.direction}")

    @property
    def order(self) -> list[str]:
        return ["ts", "pkt_no"] if self.time_ordered else ["pkt_no"]


UNIFIED = FlowProfile(
    "unified", payload_only=True, drop_udp_ports=(MDNS_PORT,), min_bytes=MIN_CAPTURE_BYTES
)
UNIFIED_PROPORTIONAL = FlowProfile(
    "unified_proportional",
    payload_only=True,
    drop_udp_ports=(MDNS_PORT,),
    min_bytes=MIN_CAPTURE_BYTES,
    proportional=True,
)
BUILD_STATS = FlowProfile(
    "build_stats", drop_udp_ports=(MDNS_PORT,), min_bytes=MIN_CAPTURE_BYTES, proportional=True
)
PROCESSOR_STATS = FlowProfile(
    "processor_stats",
    key_order="text",
    direction="client",
    outgoing=-1,
    time_ordered=True,
    ip_versions=(4,),
    kurtosis_min_n=3,
)
PROCESSOR_LENGTHS = FlowProfile(
    "processor_lengths", key_order="text", direction="client", time_ordered=True, ip_versions=(4,)
)
PROCESSOR_DIRECTIONS = FlowProfile(
    "processor_directions",
    key_order="text",
    direction="client",
    time_ordered=True,
    payload_only=True,
    drop_udp_ports=(MDNS_PORT,),
    drop_addresses=MULTICAST_ADDRESSES,
)
PROCESSOR_IMAGES = FlowProfile(
    "processor_images", key_order="text", outgoing=-1, time_ordered=True
)
