"""Column -> Column helpers (all Catalyst built-ins, so they stay inside codegen)."""

from threadlake.functions.digests import b64_to_hex, hex_to_b64, md5_b64, digest_equal
from threadlake.functions.sizes import size_bucket, size_text_mb, size_text_reject, half_even_div, format_size_text
from threadlake.functions.text import (
    html_text, py_strip, sanitize_name, strip_ext, basename, dirname, split_name_ext, normalize_rel_path,
    split_lines, indent_line, rule_line, no_message, artist_names, file_text_parts, report_date,
)
from threadlake.functions.urls import (
    is_thread_url, is_file_url, file_key, canonical_url, is_source_request, valid_folder,
    allowed_ext, pruned_dir,
)

__all__ = [
    "b64_to_hex", "hex_to_b64", "md5_b64", "digest_equal",
    "size_bucket", "size_text_mb", "size_text_reject", "half_even_div", "format_size_text",
    "html_text", "py_strip", "sanitize_name", "strip_ext", "basename", "dirname", "split_name_ext",
    "normalize_rel_path", "split_lines", "indent_line", "rule_line", "no_message", "artist_names",
    "file_text_parts", "report_date",
    "is_thread_url", "is_file_url", "file_key", "canonical_url", "is_source_request",
    "valid_folder", "allowed_ext", "pruned_dir",
]
