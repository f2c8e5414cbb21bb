"""Formulas: Office Math as a tree, and the tree as linear text or LaTeX."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..sources.xmltree import Node

DEPTH, NODES = 48, 20_000
# Greek letters and signs by their LaTeX names.
NAMES = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "varepsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda",
    "μ": "mu", "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "varphi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega",
    "∞": "infty", "±": "pm", "×": "times", "÷": "div", "⋅": "cdot", "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx", "→": "to", "∈": "in", "∑": "sum",
    "∏": "prod", "∫": "int", "∂": "partial", "∇": "nabla", "√": "surd", "∀": "forall", "∃": "exists", "⇒": "Rightarrow", "⇔": "Leftrightarrow", "∪": "cup", "∩": "cap",
}
ACCENTS = {"̂": "hat", "̃": "tilde", "̄": "bar", "̅": "overline", "̇": "dot", "̈": "ddot", "⃗": "vec"}
FUNCTIONS = {"sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp", "lim", "min", "max", "det", "gcd", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh"}


@dataclass
class Math:
    """kind: row, run, frac, script, radical, nary, delimiter, matrix, accent, bar, func, group, limit, array, box."""

    kind: str
    text: str = ""
    parts: dict[str, Math] = field(default_factory=dict)
    rows: list[list[Math]] = field(default_factory=list)


def _value(node: Node | None, tag: str, default: str = "") -> str:
    found = node.find(tag) if node is not None else None
    return default if found is None else found.get("m:val", default) or ""


def read_math(node: Node, depth: int = 0, budget: list[int] | None = None) -> Math:
    """The formula under ``m:oMath`` or any argument; too deep or too large parts are left out."""
    budget = [NODES] if budget is None else budget
    items: list[Math] = []
    for c in node.children:
        budget[0] -= 1
        if depth > DEPTH or budget[0] < 0:
            break
        own = _read(c, depth, budget)
        if own is not None:
            items.append(own)
    return items[0] if len(items) == 1 else Math("row", rows=[items])


def _read(c: Node, depth: int, budget: list[int]) -> Math | None:
    def part(tag: str) -> Math:
        found = c.find(tag)
        return read_math(found, depth + 1, budget) if found is not None else Math("row", rows=[[]])

    match c.tag:
        case "m:r":
            text = "".join(t.text for t in c.all("m:t"))
            return Math("run", text) if text else None
        case "m:f":
            return Math("frac", _value(c.find("m:fPr"), "m:type"), {"num": part("m:num"), "den": part("m:den")})
        case "m:sSup" | "m:sSub" | "m:sSubSup" | "m:sPre":
            return Math("script", "pre" if c.tag == "m:sPre" else "", {k: part(f"m:{k}") for k in ("e", "sub", "sup") if c.find(f"m:{k}") is not None})
        case "m:rad":
            hidden = _value(c.find("m:radPr"), "m:degHide", "0") in ("1", "on", "true") or c.find("m:radPr", "m:degHide") is not None and not c.find("m:radPr", "m:degHide").get("m:val")
            return Math("radical", "", {"e": part("m:e")} | ({} if hidden or c.find("m:deg") is None else {"deg": part("m:deg")}))
        case "m:nary":
            return Math("nary", _value(c.find("m:naryPr"), "m:chr", "∫") or "∫", {k: part(f"m:{k}") for k in ("sub", "sup", "e")})
        case "m:d":
            props = c.find("m:dPr")
            ends = _value(props, "m:begChr", "(") + "\0" + _value(props, "m:sepChr", "|") + "\0" + _value(props, "m:endChr", ")")
            return Math("delimiter", ends, rows=[[read_math(e, depth + 1, budget) for e in c.all("m:e")]])
        case "m:m":
            return Math("matrix", rows=[[read_math(e, depth + 1, budget) for e in r.all("m:e")] for r in c.all("m:mr")])
        case "m:eqArr":
            return Math("array", rows=[[read_math(e, depth + 1, budget)] for e in c.all("m:e")])
        case "m:acc":
            return Math("accent", _value(c.find("m:accPr"), "m:chr", "̂") or "̂", {"e": part("m:e")})
        case "m:bar":
            return Math("bar", _value(c.find("m:barPr"), "m:pos", "bot"), {"e": part("m:e")})
        case "m:func":
            return Math("func", "", {"name": part("m:fName"), "e": part("m:e")})
        case "m:limLow" | "m:limUpp":
            return Math("limit", "low" if c.tag == "m:limLow" else "upp", {"e": part("m:e"), "lim": part("m:lim")})
        case "m:groupChr":
            return Math("group", _value(c.find("m:groupChrPr"), "m:chr", "⏟"), {"e": part("m:e")})
        case "m:borderBox" | "m:box":
            return Math("box" if c.tag == "m:borderBox" else "row", "", {"e": part("m:e")}, [[part("m:e")]])
        case "m:oMath" | "m:oMathPara" | "m:e":
            return read_math(c, depth + 1, budget)
    return None


def _grouped(text: str) -> str:
    return text if len(text) <= 1 or text.isalnum() else f"({text})"


def to_linear(m: Math) -> str:
    """One line: fractions with a slash, scripts with ``^`` and ``_``."""
    p = {k: to_linear(v) for k, v in m.parts.items()}
    rows = [[to_linear(x) for x in r] for r in m.rows]
    match m.kind:
        case "run":
            return m.text
        case "row":
            return "".join(x for r in rows for x in r)
        case "frac":
            return f"{_grouped(p['num'])}/{_grouped(p['den'])}"
        case "script":
            tail = (f"_{_grouped(p['sub'])}" if "sub" in p else "") + (f"^{_grouped(p['sup'])}" if "sup" in p else "")
            return tail + p.get("e", "") if m.text == "pre" else _grouped(p.get("e", "")) + tail
        case "radical":
            return f"√({p['deg']}&{p['e']})" if p.get("deg") else f"√{_grouped(p['e'])}"
        case "nary":
            return m.text + (f"_{_grouped(p['sub'])}" if p["sub"] else "") + (f"^{_grouped(p['sup'])}" if p["sup"] else "") + f"▒{_grouped(p['e'])}"
        case "delimiter":
            begin, between, end = m.text.split("\0")
            return begin + between.join(rows[0]) + end
        case "matrix":
            return "■(" + "@".join("&".join(r) for r in rows) + ")"
        case "array":
            return "█(" + "@".join(r[0] for r in rows) + ")"
        case "accent":
            return _grouped(p["e"]) + m.text
        case "bar":
            return ("¯" if m.text == "top" else "▁") + _grouped(p["e"])
        case "func":
            return f"{p['name']}⁡{_grouped(p['e'])}"
        case "limit":
            return f"{p['e']}{'┬' if m.text == 'low' else '┴'}{_grouped(p['lim'])}"
        case "group":
            return m.text + _grouped(p["e"])
    return f"▭{_grouped(p['e'])}"


def _latex_text(text: str) -> str:
    out = []
    for c in text:
        if c in NAMES:
            out.append(f"\\{NAMES[c]} ")
        elif c in "{}#$%&_":
            out.append("\\" + c)
        elif c == "\\":
            out.append("\\backslash ")
        elif c not in "⁡​":
            out.append(c)
    return "".join(out)


def to_latex(m: Math) -> str:
    p = {k: to_latex(v).strip() for k, v in m.parts.items()}
    rows = [[to_latex(x) for x in r] for r in m.rows]
    match m.kind:
        case "run":
            return f"\\{m.text} " if m.text in FUNCTIONS else _latex_text(m.text)
        case "row":
            return "".join(x for r in rows for x in r)
        case "frac":
            return f"{p['num']}/{p['den']}" if m.text == "lin" else f"\\binom{{{p['num']}}}{{{p['den']}}}" if m.text == "noBar" else f"\\frac{{{p['num']}}}{{{p['den']}}}"
        case "script":
            tail = (f"_{{{p['sub']}}}" if "sub" in p else "") + (f"^{{{p['sup']}}}" if "sup" in p else "")
            if m.text == "pre":
                return "{}" + tail + p.get("e", "")
            base = p.get("e", "")
            return (base if len(base) <= 1 or base.startswith("\\") and base[1:].isalpha() else f"{{{base}}}") + tail
        case "radical":
            return f"\\sqrt[{p['deg']}]{{{p['e']}}}" if p.get("deg") else f"\\sqrt{{{p['e']}}}"
        case "nary":
            sign = _latex_text(m.text).strip()
            return sign + (f"_{{{p['sub']}}}" if p["sub"] else "") + (f"^{{{p['sup']}}}" if p["sup"] else "") + f"{{{p['e']}}}"
        case "delimiter":
            begin, between, end = m.text.split("\0")
            sign = lambda c: {"": ".", "{": "\\{", "}": "\\}", "‖": "\\|", "⟨": "\\langle ", "⟩": "\\rangle "}.get(c, c)
            return f"\\left{sign(begin)}" + between.join(rows[0]) + f"\\right{sign(end)}"
        case "matrix":
            return "\\begin{matrix}" + " \\\\ ".join(" & ".join(r) for r in rows) + "\\end{matrix}"
        case "array":
            return "\\begin{aligned}" + " \\\\ ".join(r[0].replace("\\&", "&") for r in rows) + "\\end{aligned}"
        case "accent":
            return f"\\{ACCENTS.get(m.text, 'hat')}{{{p['e']}}}"
        case "bar":
            return f"\\{'overline' if m.text == 'top' else 'underline'}{{{p['e']}}}"
        case "func":
            return f"{p['name']} {p['e']}" if p["name"].startswith("\\") else f"\\operatorname{{{p['name']}}} {p['e']}"
        case "limit":
            return f"{p['e']}_{{{p['lim']}}}" if m.text == "low" and p["e"].startswith("\\") else f"\\{'underset' if m.text == 'low' else 'overset'}{{{p['lim']}}}{{{p['e']}}}"
        case "group":
            return f"\\{'overbrace' if m.text == '⏞' else 'underbrace'}{{{p['e']}}}"
    return f"\\boxed{{{p['e']}}}"
