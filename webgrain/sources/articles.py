"""Journal articles in JATS as rows of blocks, and the Markdown that the blocks make."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<kind:string,level:int,label:string,text:string>>"
#: Operators and the commands they are in formulas; fixed.
OPERATORS = {"×": r"\times", "·": r"\cdot", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "∞": r"\infty", "∈": r"\in", "→": r"\to", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla", "±": r"\pm", "−": "-", "…": r"\ldots", "⁡": "", "⁢": "", "⁣": ""}
#: How elements of a formula with so many parts are written; fixed.
SHAPES = {
    "mfrac": r"\frac{{{0}}}{{{1}}}", "msqrt": r"\sqrt{{{0}}}", "mroot": r"\sqrt[{1}]{{{0}}}", "msup": "{0}^{{{1}}}", "msub": "{0}_{{{1}}}", "msubsup": "{0}_{{{1}}}^{{{2}}}",
    "mover": r"\overset{{{1}}}{{{0}}}", "munder": "{0}_{{{1}}}", "munderover": "{0}_{{{1}}}^{{{2}}}",
}


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _said(node: ElementTree.Element | None) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def _symbol(c: str) -> str:
    """A character in a formula: operators by the table, Greek letters by their Unicode name."""
    if c in OPERATORS:
        return OPERATORS[c]
    words = unicodedata.name(c, "").split()
    if words[:1] == ["GREEK"] and words[2:3] == ["LETTER"] and len(words) == 4:
        name = words[3].lower().replace("lamda", "lambda")
        return "\\" + (name.capitalize() if words[1] == "CAPITAL" else name)
    return "\\" + c if c in "%#&$_{}" else c


def tex(node: ElementTree.Element) -> str:
    """The TeX of a MathML element: tokens by symbols, shapes by a template, anything else by its parts in a row."""
    kind, parts = _name(node), [tex(k) for k in node if isinstance(k.tag, str)]
    if kind in ("mi", "mn", "mo", "mtext", "ms"):
        text = _said(node)
        if kind == "mtext":
            return rf"\text{{{text}}}" if text else ""
        made = [_symbol(c) for c in text]
        # A command is parted from a letter behind it.
        return "".join(m + " " if m.startswith("\\") and m[1:].isalpha() and i + 1 < len(made) else m for i, m in enumerate(made))
    if kind == "mtable":
        return r"\begin{matrix}" + r" \\ ".join(parts) + r"\end{matrix}"
    if kind == "mtr":
        return " & ".join(parts)
    if kind in ("annotation", "annotation-xml", "mspace", "mphantom"):
        return ""
    row = ""
    for p in parts:
        row += " " + p if re.search(r"\\[A-Za-z]+$", row) and p[:1].isalpha() else p
    if kind == "mfenced":
        return node.get("open", "(") + ", ".join(parts) + node.get("close", ")")
    shape = SHAPES.get(kind)
    need = len(set(re.findall(r"\{(\d)\}", shape or "")))
    if shape and need == 1:
        return shape.format(row)
    return shape.format(*parts[:need]) if shape and len(parts) >= need else row


class _Article:
    """One article's blocks; reference ids are numbered in the order of the list."""

    def __init__(self, root: ElementTree.Element):
        self.root = root
        self.refs = [r for b in self.all(root, "back")[:1] for r in self.all(b, "ref")]
        self.number = {r.get("id"): f"ref{i:02d}" for i, r in enumerate(self.refs, 1) if r.get("id")}
        self.formulas: list[dict] = []

    @staticmethod
    def all(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
        return [n for n in node.iter() if _name(n) == name]

    @staticmethod
    def child(node: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
        return None if node is None else next((k for k in node if _name(k) == name), None)

    def formula(self, node: ElementTree.Element) -> str:
        return tex(next(iter(self.all(node, "math")), node)).strip()

    def rich(self, node: ElementTree.Element | None, skip: tuple[str, ...] = ()) -> str:
        """Text with emphasis, citations and inline formulas. A displayed formula leaves a mark and is kept aside."""
        if node is None:
            return ""
        out = [(node.text or "").replace("$", r"\$")]
        for k in node:
            kind = _name(k)
            if kind in skip or not kind:
                pass
            elif kind == "xref" and k.get("ref-type") == "bibr":
                out += [f" [`{self.number[i]}`]" for i in (k.get("rid") or "").split() if i in self.number]
            elif kind in ("italic", "i"):
                out.append(f"*{_said(k)}*")
            elif kind in ("bold", "b"):
                out.append(f"**{_said(k)}**")
            elif kind in ("sup", "sub"):
                out.append(f"${'^' if kind == 'sup' else '_'}{{{_said(k)}}}$")
            elif kind == "inline-formula":
                if made := self.formula(k):
                    self.formulas.append({})
                    out.append(f"${made}$")
            elif kind == "disp-formula":
                self.formulas.append({"tex": self.formula(k), "label": _said(self.child(k, "label"))})
                out.append(f"{len(self.formulas) - 1}")
            else:
                out.append(self.rich(k))
            out.append((k.tail or "").replace("$", r"\$"))
        return " ".join("".join(out).split())

    def paragraph(self, text: str, kind: str = "paragraph") -> Iterator[tuple]:
        for i, part in enumerate(re.split("([0-9]+)", text)):
            if i % 2:
                f = self.formulas[int(part)]
                if f["tex"]:
                    yield "formula", 0, f["label"].strip("()"), f["tex"]
            elif part.strip():
                yield kind, 0, "", part.strip()

    def inline(self, text: str) -> str:
        return re.sub("([0-9]+)", lambda m: f"${self.formulas[int(m[1])]['tex']}$", text)

    def caption(self, node: ElementTree.Element) -> tuple[str, str]:
        text = re.sub(r"(?i)^(fig(ure)?|table)\.?\s*\w+\.?\s*", "", self.inline(self.rich(self.child(node, "caption"))))
        return self.inline(self.rich(self.child(node, "label"))), text

    def block(self, node: ElementTree.Element, level: int) -> Iterator[tuple]:
        kind = _name(node)
        if kind == "sec":
            yield "heading", level, "", self.inline(self.rich(self.child(node, "title"))) or "Section"
            for k in node:
                yield from self.block(k, level + 1)
        elif kind == "fig":
            label, text = self.caption(node)
            href = next((v for g in self.all(node, "graphic") for a, v in g.attrib.items() if a.rpartition("}")[2] == "href"), "")
            yield ("figure", 0, href, f"{label}: {text}".strip(": ")) if href else ("paragraph", 0, "", f"**{label or 'Figure'}.** {text} (figure image not in JATS).")
        elif kind == "table-wrap":
            rows = [[self.inline(self.rich(c)).replace("|", " / ") for c in r if _name(c) in ("td", "th")] for r in self.all(node, "tr")]
            rows = [r for r in rows if r]
            if rows:
                label, text = self.caption(node)
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                head = f"**{label or 'Table'}.** {text}\n\n" if label or text else ""
                yield "table", 0, label, head + "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])
        elif kind in ("list", "boxed-text"):
            for k in self.all(node, "list-item" if kind == "list" else "p"):
                yield from self.paragraph(self.rich(k), "item" if kind == "list" else "paragraph")
        elif kind == "disp-formula":
            if made := self.formula(node):
                yield "formula", 0, _said(self.child(node, "label")).strip("()"), made
        elif kind and kind not in ("title", "caption", "label", "object-id", "supplementary-material", "media"):
            yield from self.paragraph(self.rich(node))

    def blocks(self) -> Iterator[tuple]:
        meta = self.child(next(iter(self.all(self.root, "front")), None), "article-meta")
        yield "title", 0, "", self.inline(self.rich(self.child(self.child(meta, "title-group"), "article-title")))
        abstract = self.child(meta, "abstract")
        if abstract is not None:
            yield "heading", 0, "", "Abstract"
            for p in abstract:
                if _name(p) == "p":
                    yield from self.paragraph(self.rich(p))
        for k in next(iter(self.all(self.root, "body")), ()):
            yield from self.block(k, 0 if _name(k) == "sec" else 1)
        back = next(iter(self.all(self.root, "back")), None)
        ack = self.child(back, "ack")
        thanks = [x for p in (self.all(ack, "p") if ack is not None else ()) for x in self.paragraph(self.rich(p))]
        if thanks:
            yield "heading", 0, "", "Acknowledgements"
            yield from thanks
        listed = [r for r in self.refs if r.get("id")]
        if listed:
            yield "heading", 0, "", "References"
            for r in listed:
                yield "reference", 0, self.number[r.get("id")], _said(r)
        yield "inline formulas", sum(not f for f in self.formulas), "", ""


def _read(xml: str | None) -> tuple[list[dict] | None, str | None]:
    try:
        # A document type may have a subset in brackets; the parser is not to follow it.
        root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>", "", xml or "", count=1, flags=re.DOTALL))
        if _name(root) != "article":
            return None, "not an article"
        return [dict(zip(("kind", "level", "label", "text"), b, strict=True)) for b in _Article(root).blocks()], None
    except (ElementTree.ParseError, RecursionError) as e:
        return None, f"not readable: {type(e).__name__}"


def article_blocks(df: DataFrame, key: str, xml: str) -> DataFrame:
    """``key, blocks, error``: the blocks of each article in order, or why there are none."""

    @F.pandas_udf(f"struct<blocks:{BLOCKS},error:string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(t) for t in texts], columns=["blocks", "error"])

    return df.select(key, read(xml).alias("r")).select(key, "r.blocks", "r.error")


def article_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """``key, title, markdown, formulas, figures, tables, blocks, error`` of articles read by ``article_blocks``, all by expressions; ``blocks`` is their number."""

    def written(b: Column) -> Column:
        heading = F.when(b["level"] == 0, F.concat(F.lit("## "), b["text"])).when(b["level"] == 1, F.concat(F.lit("### "), b["text"])).otherwise(F.concat(F.lit("**"), b["text"], F.lit(".**")))
        tag = F.when(b["label"] == "", "").otherwise(F.concat(F.lit(r" \tag{"), b["label"], F.lit("}")))
        return (
            F.when(b["kind"] == "title", F.concat(F.lit("# "), b["text"]))
            .when(b["kind"] == "heading", heading)
            .when(b["kind"] == "item", F.concat(F.lit("- "), b["text"]))
            .when(b["kind"] == "figure", F.concat(F.lit("!["), F.left(F.translate(b["text"], "[]", ""), F.lit(160)), F.lit("]("), b["label"], F.lit(")")))
            .when(b["kind"] == "formula", F.concat(F.lit("$$"), b["text"], tag, F.lit("$$")))
            .when(b["kind"] == "reference", F.concat(F.lit("- [`"), b["label"], F.lit("`] "), b["text"]))
            .otherwise(b["text"])
        )

    shown = F.filter("blocks", lambda b: b["kind"] != "inline formulas")
    count = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind))
    inline = F.coalesce(F.get(F.filter("blocks", lambda b: b["kind"] == "inline formulas"), F.lit(0))["level"], F.lit(0))
    return blocks.select(key, F.get("blocks", F.lit(0))["text"].alias("title"), F.array_join(F.transform(shown, written), "\n\n").alias("markdown"), (count("formula") + inline).alias("formulas"), count("figure").alias("figures"), count("table").alias("tables"), F.size("blocks").alias("blocks"), "error")
