from .names import base_name, ext, is_media, lower_path, stem
from .readings import poll_stamp, rescaled
from .sizes import fmt_mb, fmt_percent, reduction_pct
from .targets import is_internal, resolve_target, rewrite_target

__all__ = [
    "base_name", "ext", "is_media", "lower_path", "stem", "poll_stamp", "rescaled",
    "fmt_mb", "fmt_percent", "reduction_pct", "is_internal", "resolve_target",
    "rewrite_target",
]
