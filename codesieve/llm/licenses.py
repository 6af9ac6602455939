"""Licence scan: one Aho-Corasick pass finds notice phrases and identifier tags; tag expressions
are evaluated by a shunting-yard parser over ``and`` / ``or`` / ``with``: to a canonical expression, to the
licences that hold whichever choice is taken, and on request to every choice."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# fixed values: base phrases and their labels
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# own notice phrases, compared as words
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
}
TAG = "spdx license identifier"
_OPERATORS = {"or": 1, "and": 2, "with": 3}

# [0-9], [a-z] and every byte from 0x80 on belong to words; A-Z is lowered; all else separates
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_EXPRESSION = re.compile(r"spdx-license-identifier\s*:[\x20\t]*([a-z0-9.+()\x20\t-]+)")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")


def parse_expression(text: str) -> list | None:
    """Licence expression -> postfix list of names and operators; None when it is not well formed.

    Words after the first complete expression end it ("MIT some words" reads as MIT).
    """
    out: list = []
    ops: list = []
    want_name = True
    for token in _TOKEN.findall(text.lower()):
        if want_name:
            if token == "(":
                ops.append(token)
            elif token in _OPERATORS or token == ")":
                return None
            else:
                out.append(token)
                want_name = False
        elif token in _OPERATORS:
            while ops and ops[-1] != "(" and _OPERATORS[ops[-1]] >= _OPERATORS[token]:
                out.append(ops.pop())
            ops.append(token)
            want_name = True
        elif token == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        else:
            break
    if want_name or "(" in ops:
        return None
    return out + ops[::-1]


class Node:
    """A licence, or an ``and`` / ``or`` of different licences (leaves) and of nodes of the other operator.

    ``required``: the names that every choice holds; ``least`` and ``size``: its first name and number of names.
    """

    __slots__ = ("op", "leaves", "nodes", "required", "least", "size")

    def __init__(self, name: str):
        self.op, self.leaves, self.nodes = "", {name}, []
        self.required, self.least, self.size = {name}, name, 1

    def joined(self, op: str, other: Node) -> Node:
        """Both under one operator; the smaller sets move into the larger ones."""
        a, b = (x._under(op) for x in (self, other))
        if len(a.leaves) + len(a.nodes) < len(b.leaves) + len(b.nodes):
            a, b = b, a
        small, large = sorted((a.required, b.required), key=len)
        if op == "and":
            large |= small
            a.required = large
        else:
            a.required = {x for x in small if x in large}
        a.leaves |= b.leaves
        a.nodes += b.nodes
        a.least, a.size = min(a.least, b.least), a.size + b.size
        return a

    def _under(self, op: str) -> Node:
        if self.op == op or (len(self.leaves) == 1 and not self.nodes):
            self.op = op
            return self
        outer = Node(self.least)
        outer.op, outer.leaves, outer.nodes = op, set(), [self]
        outer.required, outer.size = self.required, self.size
        return outer

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += node.nodes

    def names(self) -> set[str]:
        return set().union(*(node.leaves for node in self.walk()))

    def with_exception(self, exception: str) -> Node:
        def named(x: str) -> str:
            return f"{x}-with-{exception}"
        for node in self.walk():
            node.leaves, node.required = set(map(named, node.leaves)), set(map(named, node.required))
            node.least = named(node.least)
        return self

    def expression(self) -> str:
        """The licences of each operator sorted and once, then its nested parts by their first name and size."""
        out: list[str] = []
        todo: list = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            parts = [*sorted(node.leaves), *(("(", x, ")") for x in sorted(node.nodes, key=lambda x: (x.least, x.size)))]
            flat: list = []
            for part in parts:
                if flat:
                    flat.append(f" {node.op} ")
                flat += [part] if isinstance(part, str) else part
            todo += flat[::-1]
        return "".join(out)

    def choices(self) -> Iterator[frozenset[str]]:
        """Every choice, one after the other: a set of names that together satisfy the expression.

        Their number may double with each ``or``, so they are made one at a time; a set may come twice.
        """
        # (names taken, what is left to satisfy)
        todo: list[tuple[frozenset[str], tuple[Node, ...]]] = [(frozenset(), (self,))]
        while todo:
            taken, left = todo.pop()
            if not left:
                yield taken
            elif (node := left[0]).op == "or":
                todo += [(taken, (x, *left[1:])) for x in node.nodes]
                todo += [(taken | {x}, left[1:]) for x in node.leaves]
            else:
                todo.append((taken | node.leaves, (*node.nodes, *left[1:])))


def evaluate(postfix: list) -> Node:
    """Postfix expression -> its tree.  ``with`` joins each licence and the names of its exception to one name."""
    stack: list[Node] = []
    for token in postfix:
        if token not in _OPERATORS:
            stack.append(Node(token))
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(a.with_exception("+".join(sorted(b.names()))) if token == "with" else a.joined(token, b))
    return stack[-1]


def build_automaton(extra: dict[str, str] | None = None) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    phrases: dict[str, tuple[str, bool]] = {p: (label, False) for p, label in {**NOTICE_PHRASES, **(extra or {})}.items()}
    phrases |= {p: (label, True) for p, label in BASE_PHRASES.items()} | {TAG: ("", False)}
    for phrase, (label, base) in phrases.items():
        auto.add_word(f" {phrase} ", (len(phrase) + 1, label, base, phrase == TAG))
    auto.make_automaton()
    return auto


def scan_text(text: bytes, auto: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, required) of one text."""
    words = text.translate(_TABLE).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    base_at, base, labels, tagged = [], set(), set(), False
    for end, (length, label, is_base, is_tag) in auto.iter(line):
        if is_tag:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            base_at.append(end - length)
    expressions, required = set(), set()
    if tagged:
        for m in _EXPRESSION.finditer(text.decode("utf-8", "replace").lower()):
            postfix = parse_expression(m[1])
            if postfix:
                tree = evaluate(postfix)
                labels |= tree.names()
                required |= tree.required
                expressions.add(tree.expression())
    if base_at:
        first, last = (line.count(" ", 0, at + 1) - 1 for at in (min(base_at), max(base_at)))
    else:
        first = last = None
    score = 1.0 if expressions else 0.9 if base else 0.8 if labels else 0.0
    return len(words), len(base_at), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, \
        "; ".join(sorted(expressions)), ",".join(sorted(required))


_FIELDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string",
           "labels": "string", "score": "double", "expressions": "string", "required": "string"}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, required.

    score: 1 for a well-formed identifier tag, 0.9 for a base phrase, 0.8 for another notice, else 0.
    expressions: the different well-formed tags, evaluated, sorted and joined by "; "; required: the licences
    that hold whichever choice is taken in each of them.  Both are empty without such a tag.
    Texts of any length are read whole, in time that grows with their length.
    Null text counts as empty: zero words, null places, empty labels.  Rows are scanned alone:
    repeated rows give repeated results, other columns are not read.  No shuffle.  ``phrases`` adds
    further notice phrases (lower-case words joined by single spaces) with their labels.
    """
    narrow = docs.select(docs[id_col].alias(id_col), docs[text].cast("string").alias("text"))

    def run(batches):
        auto = build_automaton(phrases)
        for b in batches:
            rows = [scan_text((t or "").encode(), auto) for t in b.column(1).to_pylist()]
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            cols = [pa.array([r[i] for r in rows], kinds[k]) for i, k in enumerate(_FIELDS.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, *_FIELDS])

    schema = StructType([narrow.schema[0]])
    for name, kind in _FIELDS.items():
        schema = schema.add(name, kind)
    return narrow.mapInArrow(run, schema)
