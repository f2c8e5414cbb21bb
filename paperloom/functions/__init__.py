"""Column functions: labels, text escapes, units and sniffing. All stay in the JVM."""

from .labels import letters, list_label, note_label, number_label, ordinal, roman
from .office import (
    average_colour, axis_number, border_shows, code_page, fit, gradient_at, header_ids, highlight, json_number, language_tag, luminance, number_format,
)
from .sniff import detect_format, image_size, sniff_image
from .text import (
    base64_text, code_span, escape_html, escape_line_start, escape_markdown, file_name, href, list_marker, longest_run, percent_decode, resolved_path,
    trim_all, wrap_url, xml_text,
)
from .values import civil_date, css_length, dttm, filetime, hex_colour, measure, on_off, rgb_of, scale_channel, toggle, unit

__all__ = [n for n in dir() if not n.startswith("_")]
