"""Writers: the document model as text, Markdown, HTML and a flat block view."""

from .html import to_html
from .markdown import to_markdown
from .text import to_text
from .view import blocks_view

__all__ = ["blocks_view", "to_html", "to_markdown", "to_text"]
