"""The document parser as a table function: one partition is one document, whose lines are folded in order.

It gives the rows of ``documents.legal_nodes`` and is meant for ad-hoc SQL; a partition holds the lines of one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from normspark.operators import documents as B

_SPACE = r"[\t\n\x0b\f\r ]"


def _pattern(java: str) -> re.Pattern:
    """A pattern of the column functions, whose digits and spaces are those of ASCII."""
    return re.compile(java.replace(r"\d", "[0-9]").replace(r"\s", _SPACE))


_ARTICLE, _PARAGRAPH, _ITEM, _SUBITEM, _NOTE = map(_pattern, (B.ARTICLE, B.PARAGRAPH, B.ITEM, B.SUBITEM, B.NOTE))
_IN_FORCE = re.compile(rf"(?iu){_SPACE}+Vigência{_SPACE}*$")
_ORDINAL = re.compile(rf"(?iu)(?<=[0-9]){_SPACE}*(?:º|°|o)(?={_SPACE}*(?:-|$))")
_MARKERS = (("article", _ARTICLE), ("paragraph", _PARAGRAPH), ("item", _ITEM), ("subitem", _SUBITEM))


def _collapsed(x: str) -> str:
    return re.sub(f"{_SPACE}+", " ", x).strip(" ")


def _marker(text: str) -> tuple[str, re.Match | None]:
    for kind, pattern in _MARKERS:
        if m := pattern.search(text):
            return kind, m
    return "continuation", None


def _number(x: str) -> str:
    return x.lstrip("0") or "0"


class _Fold:
    """Context and nodes of one document."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.first: dict[str, dict] = {}  # node by plain id
        self.enter("art:")

    def enter(self, prefix: str) -> None:
        self.prefix, self.article, self.parent, self.item = prefix, None, None, None

    def line(self, raw: str) -> None:
        text = _IN_FORCE.sub("", _NOTE.sub("", raw)).strip(" ")
        note = " ".join(m.group().strip(" ") for m in _NOTE.finditer(raw))
        kind, m = _marker(text) if text else ("note", None)
        above, node_id, label = None, self.parent, ""
        if kind == "article":
            n = re.sub(rf"[.]|{_SPACE}", "", _ORDINAL.sub("", m[1])).lower()
            node_id = self.article = self.parent = self.prefix + n
            self.item = None
            base, dash, rest = n.partition("-")
            label, text = f"Art. {base}º{dash}{rest.upper()}", m[2]
        elif self.article is None:
            return
        elif kind == "paragraph":
            alone = m[1].lower().startswith("parágrafo")
            above, self.item = self.article, None
            node_id = self.parent = f"{self.article}.par:{'unico' if alone else _number(m[2])}"
            label, text = "Parágrafo único" if alone else f"§ {_number(m[2])}º", m[3]
        elif kind == "item":
            above, label, text = self.parent, m[1].upper(), m[2]
            node_id = self.item = f"{self.parent}.inciso:{label}"
        elif kind == "subitem":
            above, label, text = self.item or self.parent, m[1].lower(), m[2]
            node_id = f"{above}.alinea:{label}"
        text = _collapsed(text)
        if kind == "note":
            if note and self.nodes and self.nodes[-1]["node_id"] == node_id:
                self.nodes[-1]["extra"].append(note)
        elif text or kind == "article":
            self.take(kind, node_id, above, label, text, note)

    def take(self, kind: str, node_id: str, above: str | None, label: str, text: str, note: str) -> None:
        known = self.first.get(node_id)
        if kind == "continuation":
            if known and text not in known["text"]:
                known["text"] = f"{known['text']} {text}".strip(" ")
        elif known and known["text"] == text:
            known["note"] = " ".join(x for x in (known["note"], note) if x)
        else:
            node = {"node_id": node_id, "parent": above, "type": kind, "label": label, "text": text, "note": note, "extra": []}
            self.nodes.append(node)
            if known:
                node |= {
                    "node_id": f"{node_id}.source-variant:{len(self.nodes)}", "type": "variant", "label": label + " — redação alternativa na fonte", "note": B.VARIANT_NOTE + note,
                    "parent": node_id if kind == "article" else above}
            else:
                self.first[node_id] = node


def _lines(body) -> list[str]:
    if body is None:
        return []
    if isinstance(body, (bytes, bytearray)):
        body = B.decode_body(bytes(body))
    return B.paragraphs_of(body)[0] if isinstance(body, str) else [x for x in body if x is not None]


@udtf
class LegalNodes:
    """``legal_nodes(TABLE(t) PARTITION BY (doc), 'doc', 'body')``; ``body`` is a page (text or bytes) or an array of lines.

    Rows of one document are read one behind the other (``ORDER BY`` tells in which order); a null body has no lines.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, doc: AnalyzeArgument, body: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not all(x.isConstantExpression and isinstance(x.value, str) for x in (doc, body)):
            raise ValueError("legal_nodes takes a TABLE(...) PARTITION BY the document and the names of its document and body columns")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        if missing := [x.value for x in (doc, body) if x.value not in kinds]:
            raise ValueError(f"legal_nodes: no column {', '.join(missing)}")
        texts = ("node_id", "parent_node_id", "node_type", "label", "text", "source_note")
        return AnalyzeResult(T.StructType([T.StructField(doc.value, kinds[doc.value])] + [T.StructField(x, T.StringType()) for x in texts] + [T.StructField("order_index", T.IntegerType())]))

    def __init__(self) -> None:
        self.key, self.lines = None, []

    def eval(self, row, doc: str, body: str) -> None:
        self.key = row[doc]
        self.lines.extend(_lines(row[body]))

    def terminate(self) -> Iterator[tuple]:
        flat = [re.sub(r"^[ .:]+|[ .:]+$", "", _collapsed(x)).lower() for x in self.lines]
        last = max((i for i, x in enumerate(flat) if x in B.HEADINGS), default=None)
        fold = _Fold()
        for i, raw in enumerate(self.lines):
            if i == last:
                fold.enter("adct:art:")
            else:
                fold.line(raw)
        for i, n in enumerate(fold.nodes, 1):
            yield self.key, n["node_id"], n["parent"], n["type"], n["label"], n["text"], " ".join([n["note"], *n["extra"]]).strip(" "), i
