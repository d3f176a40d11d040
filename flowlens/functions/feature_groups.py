"""Named feature groups for ablations and grouped permutation importance
(PRJ-15..19). Names are the stripped raw headers of the training captures;
only groups' members that exist in a frame are used."""

from __future__ import annotations

from collections.abc import Sequence

# The two features removed by the main ablation (canonical names).
ABLATION_REMOVED = ("dst_port", "fwd_header_len")

# The 16 packet-length columns.
PACKET_LENGTH_FEATURES = (
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
)

# The 35 size, volume, rate and header columns (packet length,
# byte/volume, packet count/rate, header/window/segment).
SIZE_VOLUME_RATE_HEADER_FEATURES = PACKET_LENGTH_FEATURES + (
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Bytes",
    "Flow Bytes/s",
    "Total Fwd Packets", "Total Backward Packets", "Subflow Fwd Packets", "Subflow Bwd Packets",
    "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s", "act_data_pkt_fwd",
    "Fwd Header Length", "Fwd Header Length.1", "Bwd Header Length", "Init_Win_bytes_forward",
    "Init_Win_bytes_backward", "min_seg_size_forward",
)

# The nine groups of the grouped permutation importance.
FEATURE_GROUPS = {
    "port": ("Destination Port",),
    "packet_length": PACKET_LENGTH_FEATURES,
    "packet_counts": ("Total Fwd Packets", "Total Backward Packets", "Subflow Fwd Packets", "Subflow Bwd Packets", "act_data_pkt_fwd"),
    "byte_counts": ("Total Length of Fwd Packets", "Total Length of Bwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Bytes", "Flow Bytes/s"),
    "packet_rates": ("Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s"),
    "iat": (
        "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
        "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
        "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    ),
    "flags": (
        "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count",
        "CWE Flag Count", "ECE Flag Count", "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    ),
    "header_window": (
        "Fwd Header Length", "Bwd Header Length", "Fwd Header Length.1", "Init_Win_bytes_forward",
        "Init_Win_bytes_backward", "min_seg_size_forward",
    ),
    "active_idle": ("Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min"),
}


def without(features: Sequence[str], removed: Sequence[str], strict: bool = True) -> list[str]:
    """Feature list minus ``removed``; with ``strict`` every removed name must exist."""
    missing = [r for r in removed if r not in features]
    if strict and missing:
        raise ValueError(f"Features to remove are absent: {missing}")
    return [f for f in features if f not in set(removed)]


def present(columns: Sequence[str], groups: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """PRJ-19: each group reduced to the columns that exist (empty groups dropped)."""
    out = {g: [c for c in cols if c in columns] for g, cols in groups.items()}
    return {g: cols for g, cols in out.items() if cols}
