"""Prices from a model's Markdown page."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .catalog import Version, normal

#: Names of the rows of a price table, without spaces and case.
ROWS = {"input": "input", "output": "output", "cachedinput": "cached"} | {f"{a}write{b}": "write" for a in ("cache", "cached") for b in ("", "s")}
_TOKEN = re.compile(r"\d[\d,]*(?:\.\d+)?|[a-z]+|[>×]")
#: Words that multiply what was named before them.
_FACTORS = {"double": 2.0, "doubles": 2.0, "doubled": 2.0, "triple": 3.0, "triples": 3.0, "tripled": 3.0}


@dataclass
class _Part:
    """What stands below one heading: its path of headings, table rows and other lines."""

    path: tuple[str, ...]
    rows: list[list[str]] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)


def _outline(text: str) -> list[_Part]:
    parts, path = [_Part(())], []
    for line in map(str.strip, text.splitlines()):
        depth = len(line) - len(line.lstrip("#"))
        if depth and line[depth : depth + 1] == " ":
            path = [*path[: depth - 1], *[""] * (depth - 1 - len(path)), line[depth:].strip().lower()]
            parts.append(_Part(tuple(path)))
        elif line.startswith("|"):
            parts[-1].rows.append([c.strip(" *`") for c in line.strip("|").split("|")])
        elif line:
            parts[-1].lines.append(line)
    return parts


def _model_id(parts: list[_Part]) -> str | None:
    """What follows the words "Model ID", in a line or a table."""
    for part in parts:
        for cells in [*part.rows, *(re.split(r"[:`*]+", line) for line in part.lines)]:
            cells = [c for c in (c.strip() for c in cells) if c]
            for name, value in zip(cells, cells[1:], strict=False):
                if name.lower() == "model id":
                    return value
    return None


def _rates(rows: list[list[str]]) -> dict[str, float]:
    """Prices in dollars of the rows that are for a million tokens."""
    out = {}
    for name, *cells in rows:
        kind = ROWS.get("".join(name.lower().split()))
        amounts = [c for c in cells if "$" in c]
        units = {"".join(c.lower().replace(",", "").replace("/", " ").split()) for c in cells}
        if kind and amounts and any(u.endswith(("1mtokens", "1mtoken", "1000000tokens")) for u in units):
            out[kind] = float(_TOKEN.search(amounts[0].partition("$")[2])[0].replace(",", ""))
    return out


def _number(token: str) -> float | None:
    return float(token.replace(",", "")) if token[0].isdigit() else None


def _factors(tokens: list[str], kinds: set[str]) -> dict[str, float]:
    """Factors of the named kinds in a sentence: "2x input", "input tokens at 2x", "output costs 1.5 times", "rates double"."""
    out, named, spare = {}, [], None
    for i, token in enumerate(tokens):
        follows = tokens[i + 1] if i + 1 < len(tokens) else ""
        by = _FACTORS.get(token) or (_number(token) if follows in ("x", "×", "times") else None)
        if by is not None:
            out |= dict.fromkeys(named, by)
            named, spare = [], None if named else by
        elif token in kinds and token not in out:
            if spare is not None:
                out[token], spare = spare, None
            else:
                named.append(token)
    return out


def _sentences(lines: list[str]) -> list[list[str]]:
    return [_TOKEN.findall(s.lower()) for line in lines for s in re.split(r"\.\s", line)]


def _threshold(tokens: list[str]) -> tuple[int, int] | None:
    """The number of tokens after a ">" , and where the sentence goes on."""
    for i, token in enumerate(tokens[:-1]):
        if token == ">" and (n := _number(tokens[i + 1])) is not None:
            unit = {"k": 1000, "m": 1_000_000}.get(tokens[i + 2] if i + 2 < len(tokens) else "")
            return int(n * (unit or 1)), i + (3 if unit else 2)
    return None


def _scaled(rate: float | None, by: float) -> float | None:
    """A multiplied rate to 12 significant digits, so that 0.1 * 3 is 0.3."""
    return None if rate is None else float(f"{rate * by:.12g}")


def parse_page(text: str, expected: str) -> Version:
    """The prices of the page's Pricing / Text tokens section; raises ValueError for any other page."""
    parts, model = _outline(text), normal(expected)
    found = _model_id(parts)
    if found is None:
        raise ValueError("the page has no Model ID")
    if found != model:
        raise ValueError(f"Model ID mismatch: expected {model}, found {found}")
    section = next((p for p in parts if p.path[1:] == ("pricing", "text tokens")), None)
    if section is None:
        raise ValueError("the page has no Pricing / Text tokens section")
    rates = _rates(section.rows)
    if not rates.get("input", 0) > 0 or not rates.get("output", 0) > 0:
        raise ValueError("input and output prices are missing")
    long = threshold = None
    for tokens in _sentences(section.lines):
        above = _threshold(tokens)
        if above:
            by = _factors(tokens[above[1] :], {"input", "output"})
            if len(by) == 2:
                threshold, long = above[0], by
        elif "write" not in rates and "cache" in tokens and {"write", "writes"} & set(tokens):
            by = _factors(["write" if t == "writes" else t for t in tokens], {"write"})
            if by:
                rates["write"] = _scaled(rates["input"], by["write"])
    if long:
        long = tuple(_scaled(rates.get(k), long["output" if k == "output" else "input"]) for k in ("input", "cached", "write", "output"))
    digest = hashlib.sha256(text.encode()).hexdigest()
    return Version(f"{model}-page", None, True, rates["input"], rates["output"], rates.get("cached"), rates.get("write"), long, threshold, content_hash=digest, evidence="model-page")


_PAGE = "model string, input double, cached double, cache_write double, output double, long_input double, long_cached double, long_write double, long_output double, threshold long, content_hash string, error string"


def page_versions(pages: DataFrame) -> DataFrame:
    """The prices of every page of a table (``model``, ``markdown``) by ``parse_page``, batch by batch; ``error`` tells why a page
    gives none. A null page or model is such a page.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for model, markdown in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    v = parse_page(markdown or "", model or "")
                    rows.append((normal(model), v.input, v.cached, v.write, v.output, *(v.long or (None,) * 4), v.threshold, v.content_hash, None))
                except ValueError as e:
                    rows.append((normal(model), *(None,) * 10, str(e)))
            types = [pa.string(), *[pa.float64()] * 8, pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 12, types, strict=True)], names=[f.split()[0] for f in _PAGE.split(", ")])

    return pages.select("model", "markdown").mapInArrow(read, _PAGE)
