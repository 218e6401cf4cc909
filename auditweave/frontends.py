"""The languages an audit reads: their extensions, signal patterns, function headers, or a parser of their own.

A set of frontends is a value: adding a language gives a new set, which an audit takes, so audits with different
languages live side by side in one session.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from auditweave import catalog

SIGNAL_KINDS = ("source", "sink", "auth", "sanitizer")
Parse = Callable[[str, str], dict]


@dataclass(frozen=True)
class Frontends:
    extensions: dict[str, tuple[str, ...]]
    patterns: dict[str, list[tuple]]
    headers: dict[str, list[str]]
    parsers: dict[str, Parse] = field(default_factory=dict)

    def extended(self, language: str, extensions: tuple[str, ...], patterns: list[tuple] = (), headers: list[str] = (), parse: Parse | None = None) -> Frontends:
        """With a language added or replaced.

        patterns: (kind, label, regex, category or None, whether strings are kept); headers: regexes with name and parameters
        as groups 1 and 2, legal in Python and Java alike. parse(text, relative path), instead of both, is run once a file
        inside the lexing pass and returns a dict of lists: functions (name, parameters, line, end_line), signals (line, kind,
        label, category, code, variables), entries (line, method, route), references (local, target).
        """
        if not language or not isinstance(patterns, (list, tuple)) or not isinstance(headers, (list, tuple)) or not (patterns or headers or callable(parse)):
            raise TypeError("a language needs a name, and patterns and headers or a parse function")
        for kind, _, regex, _, _ in patterns:
            if kind not in SIGNAL_KINDS:
                raise ValueError(f"unknown signal kind {kind}")
            re.compile(regex)
        for regex in headers:
            if re.compile(regex).groups < 2:
                raise ValueError("a header needs two groups")
        parsers = {k: p for k, p in self.parsers.items() if k != language} | ({language: parse} if parse else {})
        return replace(self, extensions=self.extensions | {language: tuple(extensions)}, patterns=self.patterns | {language: list(patterns)}, headers=self.headers | {language: list(headers)}, parsers=parsers)

    def without(self, language: str) -> Frontends:
        left = lambda table: {k: v for k, v in table.items() if k != language}
        return replace(self, extensions=left(self.extensions), patterns=left(self.patterns), headers=left(self.headers), parsers=left(self.parsers))

    @property
    def languages(self) -> list[str]:
        return sorted(self.extensions)


BUILT_IN = Frontends(catalog.EXTENSIONS, catalog.PATTERNS, catalog.HEADERS)
