"""The plug-ins that come with the engine, by id, over tables that describe a computer."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any, TextIO
from urllib.parse import quote_plus

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import calculator, clock
from quern.operators import providers as P
from quern.operators.settings import Setting, resolved

# Engines of the web search: id, name, site, start of a search's address.
ENGINES = [("google", "Google", "google.com", "https://www.google.com/search?q="), ("duckduckgo", "DuckDuckGo", "duckduckgo.com", "https://duckduckgo.com/?q="), ("github", "GitHub", "github.com", "https://github.com/search?q=")]
MOST_ITEMS = 50


def web_search(query: str, settings: dict) -> list[dict]:
    """A link to each engine's answer, the preferred one's first; without a query, to the engines."""
    query, first = query.strip(), settings.get("first", "google")
    out = []
    for engine, name, site, start in sorted(ENGINES, key=lambda e: e[0] != first):
        url = start + quote_plus(query) if query else f"https://{site}"
        out.append({"title": f"{name}: {query}" if query else name, "subtitle": site, "action": {"open": url}})
    return out


def sums(query: str, settings: dict) -> list[dict]:
    """A time, a date, a sum, a conversion or money. ``settings`` has now (with a zone), rates and home."""
    told = clock.answer(query, settings.get("now") or datetime.now().astimezone())
    if told:
        return [{"title": told[0], "subtitle": told[1], "action": {"copy": told[0]}}]
    value = calculator.calculate(query, settings.get("rates"), settings.get("home", "USD"))
    return [{"title": value, "action": {"copy": value}}] if value else []


def _items(rows: DataFrame, title: str, **more: str) -> list[dict]:
    """Rows, which are as many as a list shows, as items."""
    return [{"title": r[title], **{k: r[v] for k, v in more.items()}} for r in rows.limit(MOST_ITEMS).toLocalIterator()]


def of_tables(tables: dict[str, DataFrame]) -> dict[str, Callable[[str, dict], list[dict]]]:
    """Plug-ins that list the rows of ``tables``: apps, processes, sockets, services, windows, copies, marks
    and visits; those without their table are left out."""
    spark = next(iter(tables.values())).sparkSession
    out: dict[str, Callable[[str, dict], list[dict]]] = {"system": lambda q, s: _items(P.commands(spark, q), "title", fills="fills")}
    if "apps" in tables:
        out["apps"] = lambda q, s: _items(P.apps(tables["apps"], q), "name")
    if "processes" in tables:
        out["processes"] = lambda q, s: _items(P.by_memory(tables["processes"], P.words_of(q)), "name", pid="pid")
        out["top"] = lambda q, s: _items(P.process_tree(tables["processes"], P.words_of(q)), "name", pid="pid", depth="depth")
    if "sockets" in tables:
        out["ports"] = lambda q, s: _items(P.ports(tables["sockets"], q).withColumn("title", F.concat_ws(" · ", F.col("port").cast("string"), "name")), "title", subtitle="reach")
    if "services" in tables:
        out["services"] = lambda q, s: _items(P.listed(tables["services"], ["unit"], q), "unit", active="active")
    if "windows" in tables:
        out["windows"] = lambda q, s: _items(P.listed(tables["windows"], ["title", "app"], q), "title", app="app")
    if "copies" in tables:
        out["clipboard"] = lambda q, s: _items(P.copies(tables["copies"], q), "text", copied="copied")
    if "marks" in tables and "visits" in tables:
        out["browser"] = lambda q, s: _items(P.browsed(tables["marks"], tables["visits"], q, s.get("results", 3)), "title", subtitle="url")
    return out


#: Plug-ins that need no table, with their settings.
ALWAYS: dict[str, tuple[Callable[[str, dict], list[dict]], list[Setting]]] = {
    "calculator": (sums, []),
    "web-search": (web_search, [Setting("first", "choice", "google", options=tuple(e[0] for e in ENGINES))]),
}


def registry(tables: dict[str, DataFrame]) -> dict[str, Callable[[str, dict], list[dict]]]:
    """All plug-ins by id, each giving items for a query and its settings, which are checked first."""

    def checked(answer, settings):
        return lambda query, values: answer(query, resolved(settings, values)[0] | {k: v for k, v in values.items() if k in ("now", "rates", "home")})

    return {k: checked(f, s) for k, (f, s) in ALWAYS.items()} | (of_tables(tables) if tables else {})


def serve(answer: Callable[[str, dict], list[dict]], lines: TextIO | Iterator[str] = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answer a JSON line with one, for as long as there are any: ``{"query", "settings"}`` with
    ``{"items"}`` or ``{"error"}``. A failure answers its own line only."""
    for line in lines:
        reply: dict[str, Any]
        try:
            asked = json.loads(line)
            reply = {"items": answer(asked["query"], asked.get("settings") or {})[:MOST_ITEMS]}
        except Exception as e:  # the asker is told
            reply = {"error": str(e) or type(e).__name__}
        out.write(json.dumps(reply, ensure_ascii=False) + "\n")
        out.flush()
