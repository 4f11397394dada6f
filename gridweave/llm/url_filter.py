"""URL rules as glob patterns in one bit-parallel automaton.

A URL's canonical form is its host, with A-Z lower-cased, and its path, end to end. Rules become globs over that form:
the host itself and any subdomain, then the path and anything. All globs share one array of 64-bit words with a bit per
pattern position; one step of the Shift-And simulation advances every position of every pattern on one byte, for all URLs
of a batch at once: D' = ((D << 1 | starts) & accepts[byte]) | (D & loops[byte]). `*` matches within a host label
sequence (anything but a slash) where it stands in the host, and anything in the path.

Edge cases: a null URL or one without `://` has an empty host and path and fits no rule; empty and very long URLs are
ordinary (a batch is narrowed to the URLs that still have bytes); of equally long fitting rules a block wins; repeated
rows are judged each; an empty table gives no rows; an empty rule list fits nothing; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host and path). The longest rule that fits wins.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """Globs compiled to masks. A glob is a list of steps: a byte, or a set of bytes that may repeat (also not occur)."""

    def __init__(self, globs: list[list[int | np.ndarray]]):
        # A position is a byte to match; a repeatable set loops on the position before it, or on the pattern's start.
        bits = sum(1 + sum(isinstance(s, int) for s in g) for g in globs)
        self.words = max(1, -(-bits // 64))
        self.starts = np.zeros(self.words, np.uint64)
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        at = 0
        for g in globs:
            self._set(self.starts, at)
            for s in g:
                if isinstance(s, int):
                    at += 1
                    self._set(self.step[s], at)
                else:
                    for byte in np.flatnonzero(s):
                        self._set(self.loop[byte], at)
            self.ends.append((at // 64, np.uint64(1) << np.uint64(at % 64)))
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """A row per URL, a column per glob: whether the whole URL matches."""
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        data = np.frombuffer(b"".join(urls), np.uint8)
        state = np.tile(self.starts, (len(urls), 1))
        one, carry = np.uint64(1), np.uint64(63)
        live = len(urls)
        for i in range(int(size.max(initial=0))):
            while size[order[live - 1]] <= i:
                live -= 1
            now = order[:live]
            byte, d = data[begin[now] + i], state[now]
            shifted = d << one
            shifted[:, 1:] |= d[:, :-1] >> carry
            state[now] = (shifted & self.step[byte]) | (d & self.loop[byte])
        return np.stack([(state[:, w] & b) != 0 for w, b in self.ends], 1) if self.ends else np.zeros((len(urls), 0), bool)


def compile_rules(rules: list[tuple[str, str]]) -> Automaton:
    """Two globs per rule: its host, and any subdomain of it."""
    anything = np.ones(256, bool)
    in_host = anything.copy()
    in_host[ord("/")] = False
    globs: list[list[int | np.ndarray]] = []
    for _, rule in rules:
        body = [*rule.encode(), anything]
        globs += [body, [in_host, ord("."), *body]]
    return Automaton(globs)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, the longest rule that fits or null, and its verdict or the default."""
    machine = compile_rules(rules)
    rank = np.array([len(r) * 2 + (v == "block") for v, r in rules], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [(h + p).encode() for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            found = machine.matches(urls)
            fits = found[:, 0::2] | found[:, 1::2]
            score = np.where(fits, rank, -1)
            best = score.argmax(1) if len(rules) else np.zeros(len(urls), int)
            hit = fits.any(1)
            names = [rules[k][1] if h else None for k, h in zip(best, hit, strict=True)]
            said = [rules[k][0] if h else default for k, h in zip(best, hit, strict=True)]
            yield pa.record_batch([b.column("page_id"), b.column("host"), b.column("path"), pa.array(names, pa.string()), pa.array(said, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
         ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), judged AS (
  SELECT p.*, (SELECT arg_max(r.rule, length(r.rule)) FROM rules r
               WHERE (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)) AS rule
  FROM parts p
)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(r.verdict, 'allow') AS verdict
FROM judged j LEFT JOIN rules r ON r.rule = j.rule
"""
