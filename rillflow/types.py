"""Status vocabularies of flow tables. The bit values are fixed: predicates over existing flow files depend on them."""

from __future__ import annotations

# Flow status bits.
FLOW_STATUS = {"inverted": 0x1, "l2": 0x4, "arp": 0x40, "vlan": 0x100, "ipv4": 0x4000, "ipv6": 0x8000}
# TCP anomaly bits, from the lowest.
TCP_ANOMALY = {"fin_ack": 0x1, "syn_ack": 0x2, "rst_ack": 0x4, "syn_fin": 0x8, "syn_rst": 0x10, "fin_rst": 0x20, "null": 0x40, "xmas": 0x80, "option_corrupt": 0x100, "syn_retry": 0x200, "seq_retry": 0x400, "out_of_order": 0x800, "loss": 0x1000, "jump": 0x2000, "ack_out_of_order": 0x4000, "dup_ack": 0x8000}
# TCP header flags, from the lowest bit, with their letters.
TCP_FLAGS = {"F": 0x1, "S": 0x2, "R": 0x4, "P": 0x8, "A": 0x10, "U": 0x20, "E": 0x40, "C": 0x80}
# Idle seconds after which a connection in a state ends.
STATE_TIMEOUT = {"new": 120.0, "established": 610.0, "closing": 120.0, "closed": 10.0, "reset": 0.1}
#: Idle seconds of any other flow.
FLOW_TIMEOUT = 182.0
# IP protocol numbers.
PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 46: "RSVP", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 89: "OSPF", 112: "VRRP", 132: "SCTP"}
