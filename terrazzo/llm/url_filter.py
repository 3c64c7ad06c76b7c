"""URL filtering with a bit-parallel wildcard automaton.

Globs are compiled into one multiword Shift-And automaton: every glob owns a run of state
bits, all globs advance together with a shift, two masks and an or per URL byte, and numpy
advances all URLs of a batch at once. ``*`` matches any bytes but ``/``, ``**`` any bytes,
``?`` one byte; a glob must match the whole canonical URL, which is ``.host`` + path + query.
Rules are globs too, and must match ``.host`` + path: a query never lends a path to a host.

Defined cases: a null url, or one without ``://``, has an empty host and path (canonical
form ``.``) and is judged by the method; rows are judged one by one, so repeated rows get
equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import annotate, blobs, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the form (host, path, verdict); a rule covers the host and its subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Globs for URLs that no rule fits: the longest that matches decides, else ``allow``.
GLOBS = (
    (".", "block"),
    ("**/login**", "block"),
    ("**/wp-admin/**", "block"),
    ("**/cgi-bin/**", "block"),
    ("*.xxx/**", "block"),
    ("**.exe", "block"),
    ("**.zip", "block"),
    ("**sessionid=**", "block"),
    ("**/*1234*.html", "block"),
    ("**/robots.txt", "allow"),
)


@dataclass(frozen=True)
class Automaton:
    """Masks per byte value: ``step`` for the shifted states, ``stay`` for wildcard loops."""

    step: np.ndarray  # 256 x words
    stay: np.ndarray
    start: np.ndarray
    accept: tuple[tuple[int, int], ...]  # word and bit of each glob's last state

    @classmethod
    def of(cls, globs: list[bytes]) -> Automaton:
        layout, n = [], 0
        for g in globs:
            items, i = [], 0  # a state is (byte it consumes or None for any, loop kind)
            states: list[list] = [[-1, 0]]
            while i < len(g):
                if g[i : i + 1] == b"*":
                    wide = g[i + 1 : i + 2] == b"*"
                    states[-1][1] = max(states[-1][1], 2 if wide else 1)
                    i += 1 + wide
                else:
                    states.append([256 if g[i : i + 1] == b"?" else g[i], 0])
                    i += 1
            items.extend(states)
            layout.append((n, items))
            n += len(items)
        words = n // 64 + 1
        step, stay, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
        accept = []
        for at, items in layout:
            start[at // 64] |= np.uint64(1 << at % 64)
            for k, (byte, loop) in enumerate(items):
                w, bit = (at + k) // 64, np.uint64(1 << (at + k) % 64)
                if byte == 256:
                    step[:, w] |= bit
                elif byte >= 0:
                    step[byte, w] |= bit
                if loop:
                    stay[:, w] |= bit
                    if loop == 1:
                        stay[ord("/"), w] &= ~bit
            last = at + len(items) - 1
            accept.append((last // 64, last % 64))
        return cls(step, stay, start, tuple(accept))

    def match(self, rows: list[bytes]) -> np.ndarray:
        """Boolean rows x globs. Rows run longest first, so the live ones are a prefix."""
        size = np.array([len(x) for x in rows], np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        data = np.frombuffer(b"".join(rows[i] for i in order), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(rows) else size
        state = np.repeat(self.start[None, :], len(rows), 0)
        one, top = np.uint64(1), np.uint64(63)
        live = len(rows)
        for j in range(int(size[0]) if len(rows) else 0):
            live = int(np.searchsorted(-size[:live], -j, "left"))  # those with size > j
            byte, now = data[at[:live] + j], state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.step[byte]) | (now & self.stay[byte])
        hit = np.stack([(state[:, w] >> np.uint64(b)) & one for w, b in self.accept], 1).astype(bool)
        out = np.empty_like(hit)
        out[order] = hit
        return out


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Append host, path, their joint form and the canonical form (native expressions only)."""
    at = F.locate("://", quoted(url))
    rest = F.when(at > 0, F.expr("substring(`%s`, locate('://', `%s`) + 3)" % ((url.replace("`", "``"),) * 2))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return df.withColumns({"host": host, "path": path, "_place": F.concat(F.lit("."), host, path), "_canonical": F.concat(F.lit("."), host, path, query)})


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, globs=GLOBS, default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """Append host, path, rule, glob and verdict to each row."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    others = sorted(globs, key=lambda g: -len(g[0]))
    names = [h + p for h, p, _ in ranked] + [None]
    labels = [g for g, _ in others] + [None]
    verdicts = [v for *_, v in ranked], [v for _, v in others] + [default]
    machines = Automaton.of([f"*.{h}{p}**".encode() for h, p, _ in ranked]), Automaton.of([g.encode() for g, _ in others])

    def judge(place: pa.Array, canonical: pa.Array) -> list:
        ruled, globbed = (m.match(blobs(x)) for m, x in zip(machines, (place, canonical), strict=True))
        none = np.ones((len(ruled), 1), bool)
        # the first hit in order of length wins; the last column stands for "none"
        rule = np.argmax(np.hstack([ruled, none]), 1)
        other = np.argmax(np.hstack([globbed, none]), 1)
        verdict = [verdicts[0][r] if r < len(ranked) else verdicts[1][o] for r, o in zip(rule, other, strict=True)]
        return [pa.array([names[r] for r in rule], pa.string()), pa.array([labels[o] for o in other], pa.string()), pa.array(verdict, pa.string())]

    fields = T.StructType([T.StructField(c, T.StringType()) for c in ("rule", "glob", "verdict")])
    columns = df.columns if keep is None else keep
    columns = [c for c in columns if c not in ("host", "path")] + ["host", "path"]
    return annotate(parts(df, url), judge, ["_place", "_canonical"], fields, columns)


#: DuckDB SQL for the rows of ``filter_urls`` under the default rules and globs.
ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM cut
), ruled AS (
  SELECT *, '.' || host || path || query AS c,
    CASE WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts
), globbed AS (
  SELECT *, CASE
    WHEN contains(c, '/wp-admin/') THEN '**/wp-admin/**'
    WHEN contains(c, 'sessionid=') THEN '**sessionid=**'
    WHEN regexp_full_match(c, '.*/[^/]*1234[^/]*\.html', 's') THEN '**/*1234*.html'
    WHEN contains(c, '/cgi-bin/') THEN '**/cgi-bin/**'
    WHEN ends_with(c, '/robots.txt') THEN '**/robots.txt'
    WHEN contains(c, '/login') THEN '**/login**'
    WHEN regexp_full_match(c, '[^/]*\.xxx/.*', 's') THEN '*.xxx/**'
    WHEN ends_with(c, '.exe') THEN '**.exe'
    WHEN ends_with(c, '.zip') THEN '**.zip'
    WHEN c = '.' THEN '.' END AS "glob" FROM ruled
)
SELECT page_id, host, path, rule, "glob",
  CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow'
       WHEN "glob" = '**/robots.txt' OR "glob" IS NULL THEN 'allow' ELSE 'block' END AS verdict
FROM globbed
"""
