"""Command line: ``python -m paperloom COMMAND FILE``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import api
from .sources.containers import open_zip


def info(doc: api.Document) -> dict:
    kinds = [b["kind"] for b in doc.blocks()]
    counts = {kind: kinds.count(kind) for kind in ("heading", "paragraph", "list_item", "table")}
    model = doc.model
    more = {"sections": len(model.sections), "footnotes": len(model.footnotes), "endnotes": len(model.endnotes), "comments": len(model.comments), "images": len(model.media)}
    return {"format": doc.format, "blocks": len(kinds), **counts, **more, "pages": doc.page_count(), "fonts": doc.fonts, "metadata": doc.metadata}


def emit(text: str, target: str | None) -> None:
    """To a file, or to the standard output."""
    if target:
        Path(target).write_text(text, "utf-8")
    else:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")


def chosen(spec: str, n: int) -> list[int]:
    """Pages of ``1,3-5``, from 0; those that aren't there are left out."""
    out = []
    for part in spec.split(","):
        first, _, last = part.partition("-")
        out += range(int(first), int(last or first) + 1)
    return [p - 1 for p in out if 1 <= p <= n]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="paperloom", description="Look into office documents and convert them.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in [
        ("info", "counts and metadata"), ("text", "plain text"), ("md", "Markdown"), ("html", "HTML"), ("json", "the model, or its blocks"),
        ("images", "write the images to a folder"), ("parts", "the package's parts"), ("hex", "bytes of the file or of a part"),
        ("xml", "a part, indented"), ("convert", "by the target's extension"), ("diagnostics", "what was left out"), ("fonts", "fonts asked for"),
    ]:
        sub = commands.add_parser(name, help=what)
        sub.add_argument("file")
        sub.add_argument("--password")
        sub.add_argument("-o", "--output")
        if name in ("text", "md", "html"):
            sub.add_argument("--pages")
            sub.add_argument("--headers-footers", action="store_true")
        if name == "json":
            sub.add_argument("--blocks", action="store_true")
            sub.add_argument("--pretty", action="store_true")
        if name in ("hex", "xml"):
            sub.add_argument("part", nargs="?" if name == "hex" else None)
        if name == "convert":
            sub.add_argument("target")
    return top


def part_of(file: str, name: str) -> bytes:
    got = open_zip(Path(file).read_bytes()).read(name)
    if got is None:
        raise ValueError(f"no part {name}")
    return got[0]


def run(args: argparse.Namespace) -> None:
    match args.command:
        case "convert":
            return api.convert(args.file, args.target, args.password)
        case "parts":
            return emit("\n".join(open_zip(Path(args.file).read_bytes()).names()), args.output)
        case "hex":
            return emit(api.hexdump(part_of(args.file, args.part) if args.part else Path(args.file).read_bytes()), args.output)
        case "xml":
            return emit(api.pretty_xml(part_of(args.file, args.part)), args.output)
    doc = api.Document(args.file, password=args.password)
    match args.command:
        case "text" | "md" | "html":
            spec = {"text": "text", "md": "markdown", "html": "html"}[args.command]
            options = {"headers_footers": args.headers_footers}
            if args.pages:
                pages = doc.pages()
                return emit("".join(t for i in chosen(args.pages, len(pages)) for t in pages[i : i + 1].to(spec, **options)), args.output)
            emit(doc.to(spec, **options), args.output)
        case "json":
            emit(json.dumps(doc.blocks(), ensure_ascii=False, indent=2 if args.pretty else None) if args.blocks else doc.to_json(args.pretty), args.output)
        case "info":
            emit(json.dumps(info(doc), ensure_ascii=False, indent=2), args.output)
        case "diagnostics":
            emit("\n".join(": ".join(d) for d in doc.diagnostics), args.output)
        case "fonts":
            emit("\n".join(doc.fonts), args.output)
        case "images":
            folder = Path(args.output or ".")
            folder.mkdir(parents=True, exist_ok=True)
            for name, _, data in doc.images():
                (folder / Path(name).name).write_bytes(data)


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except (OSError, ValueError) as e:
        print(f"paperloom: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
