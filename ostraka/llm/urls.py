"""URL filters: allow and block rules, and logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import url_labels
from .common import in_arrow

BUCKETS, SIZES = 1 << 15, (2, 3, 4, 5)
#: From which score on a url is blocked, set by names held out in four folds: about 98 of 100 wanted urls stay, three of four unwanted ones go.
THRESHOLD = 0.45


#: Endings and first labels under which every labelled name is shown to the model, in both classes alike: they say nothing by themselves.
ENDINGS, FIRSTS = ("com", "net", "org", "info", "co.uk", "site.com"), ("", "www.", "m.", "blog.")
#: Syllables of names that mean nothing; as many such names as there are labelled ones count as wanted, since a word that is not known is no reason to block.
SYLLABLES = "ba ca da en fo ga ha in ja ko la mi no or pa qui ra so ta un va wi xe yo zu er th st an ing ou ble".split()


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for unwanted) of the small labelled table, in the order of its hosts; each host stands under two endings and first labels, and behind each list come made-up names that are wanted."""
    out, n = [], 0
    for label, text in ((1, url_labels.UNWANTED), (0, url_labels.WANTED)):
        for line in text.split("\n"):
            if not line:
                continue
            host, *paths = line.split()
            name = host.rsplit(".", 1)[0]
            for k in (n, n + 5):
                shown = f"{FIRSTS[k % len(FIRSTS)]}{name}.{ENDINGS[k % len(ENDINGS)]}"
                out += [(f"https://{shown}{path}", label) for path in ("", *paths)]
            made = "".join(SYLLABLES[(7 * n + k * (3 + n // len(SYLLABLES))) % len(SYLLABLES)] for k in range(2 + n % 4))
            out += [(f"https://{FIRSTS[n % len(FIRSTS)]}{made}.{ENDINGS[(n // 4) % len(ENDINGS)]}{path}", 0) for path in ("", f"/{made[::-1]}/{n}")]
            n += 1
    return out


def name_of(host: str) -> str:
    """A labelled host without the first labels and endings that labelled_urls() gives it."""
    first = next((f for f in FIRSTS if f and host.startswith(f)), "")
    ending = next((e for e in sorted(ENDINGS, key=len, reverse=True) if host.endswith("." + e)), "")
    return host[len(first) : len(host) - len(ending) - 1] if ending else host


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".format(u="`url`"))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (host/path) that fits, as struct(rule, verdict); null if none fits. Equal lengths: the longer host first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"), r[1])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct character n-grams of host and path, each marked by its part; digits count alike."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        text = "".join("0" if c.isdigit() else c for c in text)
        for n in SIZES:
            found.update(mark + text[i : i + n] for i in range(len(text) - n + 1))
    return np.array(sorted(zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in found), np.int64)


def split_url(url: str | None) -> tuple[str, str]:
    """parts() in Python, for training rows."""
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def fit(labelled: Iterable[tuple[str, int]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression, by gradient steps on the mean loss (Adagrad)."""
    rows = [(grams(*split_url(u)), y) for u, y in labelled]
    weights, bias, seen = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8)
    for _ in range(rounds):
        slope, lean = decay * weights, 0.0
        for at, y in rows:
            wrong = (1 / (1 + np.exp(-(weights[at].sum() / np.sqrt(max(len(at), 1)) + bias))) - y) / len(rows)
            np.add.at(slope, at, wrong / np.sqrt(max(len(at), 1)))
            lean += wrong
        seen += slope**2
        weights -= rate * slope / np.sqrt(seen)
        bias -= rate * lean
    return weights, float(bias)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: Iterable[tuple[str, int]] | None = None, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each row of pages: page_id, host, path, rule, verdict (allow or block), score (of the regression: blocking).

    rules: (verdict, "host/path") pairs, a short list; the longest that fits decides, else the regression: block from
    `threshold` up. The model is fitted here from a small labelled table and its 32,768 weights go to the tasks. A null url or
    one without `://` has empty host and path and is judged by the regression like any other, that is by its bias and the n-grams of an
    empty name; ids, null or repeated, are carried as they are; a url may be of any length; an empty table gives no rows.
    """
    weights, bias = fit(labelled_urls() if labelled is None else labelled)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    host, path = parts(F.coalesce("url", F.lit("")))
    split = rows.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select("page_id", host.alias("host"), path.alias("path"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, (h, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = grams(h, p)
                out[i] = 1 / (1 + np.exp(-(weights[at].sum() / np.sqrt(max(len(at), 1)) + bias)))
            yield {"page_id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "score": out}

    kind = dict(split.dtypes)["page_id"]
    scored = in_arrow(split, score, f"page_id {kind}, host string, path string, score double")
    ruled = scored.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")
