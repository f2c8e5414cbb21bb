"""Pages from the document model, with fixed font metrics."""

from .pages import Page, PageSetup, paginate, pages_of, select_pages

__all__ = ["Page", "PageSetup", "pages_of", "paginate", "select_pages"]
