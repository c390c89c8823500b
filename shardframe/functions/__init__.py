"""Column functions."""

from shardframe.functions.numbers import ceil_div, eta, floor_div, floor_pow2, percent, prod
from shardframe.functions.paths import append_path, path_parts, rel_path, trim_last_ext
from shardframe.functions.peers import ipv4_to_long, long_to_ipv4, parse_peers
from shardframe.functions.text import show_bytes, show_rate, show_size

__all__ = [
    "append_path", "ceil_div", "eta", "floor_div", "floor_pow2", "ipv4_to_long", "long_to_ipv4",
    "parse_peers", "path_parts", "percent", "prod", "rel_path", "show_bytes", "show_rate", "show_size",
    "trim_last_ext",
]
