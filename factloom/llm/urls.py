"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

The model is fitted on the driver from a small labelled URL table (default: ``LABELLED``): n-grams of 3
to 5 bytes of the host (``^`` and ``$`` mark its ends) and of the path, hashed into a fixed number of weights.
Its size does not depend on the data, so it travels with the function. A pass over ``pages`` is a map: no
shuffle; a batch's n-grams are hashed and summed as arrays.

``LABELLED`` is made by a rule from words that name a kind of site (``UNWANTED``, ``WANTED``), set into the same
frames for both kinds, so frames, endings and paths say nothing and only the kind's word does. ``HELD_URLS``
(sites of the same kinds under other names, some of kinds the table does not know) measure what was learned.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict
that the model gives for empty strings (its bias: allow); rows keep their number; repeated rows are judged alike;
of rules of one length the one with the longer host wins; very long urls are judged whole; null page_id
stays null; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import textops as X

SIZE = 1 << 16
GRAMS = (3, 4, 5)
#: words of hosts that a crawl does not want: gambling, adult, pills, spam, tracking, fraud, pirated software
UNWANTED = """casino poker roulette blackjack slots jackpot bingo bets betting lottery gamble wager
adult porn xxx sex webcam escort nude fetish hentai erotic
pills viagra cialis steroid pharma tramadol xanax meds
spam clickbait seo linkfarm farm doorway backlinks
ads adserver banner popup tracker track tracking telemetry affiliate
phishing scam hoax fraud fakebank replica counterfeit payday loans
warez crack keygen torrent malware botnet trojan""".split()
WANTED = """news journal gazette times radio weather politics sport football tennis cycling hiking
library museum archive gallery theatre opera music film book novel poetry history
university school college science physics chemistry biology maths astronomy medicine
garden recipes kitchen bread travel camping birds dogs cats horses forest river
docs manual wiki code software linux python compiler database network forum blog
council government parliament court police hospital clinic health post bank insurance tax
railway airport harbour bridge church village city family children knitting pottery chess""".split()
#: where the words stand; the same for both kinds
FRAMES = ["http://www.{0}-{1}.test/", "https://{1}{0}.test/en/{2}", "http://{1}-{0}.test/{1}.html", "https://m.{0}{1}.test/{2}/{1}?page={2}", "http://blog.{1}.{0}.test/de/{2}", "https://{0}.test/index.html"]
FILL = "royal best online my first daily great open free cheap win star house world land club point zone city24 plus".split()
#: hosts of the same kinds that stand in no row of the table, to measure on
HELD_URLS: list[tuple[str, int]] = [
    *((f"http://{u}", 1) for u in "www.casinolux.test/en/3 bigpoker.test/play m.roulette77.test/x slotsmania.test/spin jackpot-party.test/ bingo-hall.test/room betsmart.test/live adultfinder.test/a pornhut.test/1 xxxtube.test/watch sexchat.test/room viagra4you.test/buy pillsdirect.test/order seo-boost.test/links spamking.test/x popunder-ads.test/s adserver9.test/c tracker-hub.test/p warezbay.test/f crackzone.test/k torrentking.test/t scamalert-win.test/a payday-now.test/l replicawatch.test/w onlinegambling.test/g stripclub.test/x kasyno.test/gra".split()),
    *((f"http://{u}", 0) for u in "localnews.test/today www.thejournal.test/a sciencehub.test/x m.gardenclub.test/roses birdwatch.test/list pythonschool.test/1 townlibrary.test/b museumofart.test/c weathermap.test/d chessclub.test/e hospital-north.test/f citycouncil.test/g linuxforum.test/h breadbaking.test/i travelblog.test/j filmfestival.test/k radiofive.test/l taxoffice.test/m familydoctor.test/n villagepost.test/o quilting.test/p sailing.test/q geology.test/r beekeeping.test/s www.orchestra.test/t stamp-collectors.test/u kindergarten.test/v".split()),
]


def labelled_table() -> list[tuple[str, int]]:
    """(url, 1 for block): every word in every frame, filled by turns."""
    rows = []
    for y, words in ((1, UNWANTED), (0, WANTED)):
        for i, word in enumerate(words):
            for j, frame in enumerate(FRAMES):
                rows.append((frame.format(word, FILL[(7 * i + 3 * j) % len(FILL)], (31 * i + j) % 900), y))
    return rows


LABELLED = labelled_table()


def split_url(url: str | None) -> tuple[str, str]:
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")


def _strings(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and weight of each n-gram of a batch, of length 1 by row. The host's last
    label (the kind of registry) is left out when more stand before it."""
    names = [h.rsplit(".", 1)[0] for h in hosts]
    row, col, val = [], [], []
    for salt, texts, weight in ((1, [f"^{n}$" for n in names], 1.0), (2, list(paths), 0.15)):
        data, at = X.flat(pa.array(texts, pa.string()))
        base = X._BYTE[data]
        who = np.repeat(np.arange(len(texts)), np.diff(at))
        for n in GRAMS:
            g = X.grams(base, n)
            if len(g):
                ok = who[: len(g)] == who[n - 1 :]
                row.append(who[: len(g)][ok])
                col.append((X.mix(g[ok] + X.U(salt)) >> X.U(48)).astype(np.int64) % SIZE)
                val.append(np.full(int(ok.sum()), weight))
    row, col, val = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((row, np.int64), (col, np.int64), (val, float)))
    pair, where = np.unique(row * SIZE + col, return_inverse=True)
    val = np.bincount(where, val, len(pair))
    row, col = pair // SIZE, pair % SIZE
    norm = np.sqrt(np.bincount(row, val * val, len(names)))
    return row, col, val / norm[row]


def train(rows: Iterable[tuple[str, int]], steps: int = 400, rate: float = 0.05, l2: float = 1e-5, prior: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows, from zero: the same rows give the same model. The bias is
    held at the log odds of ``prior``: an address of which nothing is known is unwanted with this chance."""
    rows = list(rows)
    row, col, val = _strings(*zip(*(split_url(u) for u, _ in rows), strict=True))
    y, w, b = np.array([v for _, v in rows], float), np.zeros(SIZE), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(SIZE), np.zeros(SIZE)
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], len(rows)) + b
        g = np.bincount(col, val * ((1 / (1 + np.exp(-z)) - y) / len(rows))[row], SIZE) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w, b


def chances(weights: np.ndarray, bias: float, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
    """P(block) of each row."""
    row, col, val = _strings(hosts, paths)
    return 1 / (1 + np.exp(-(np.bincount(row, val * weights[col], len(hosts)) + bias)))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    fits = lambda r: ((host == r[0]) | host.endswith(f".{r[0]}")) & path.startswith(r[1])
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        name, verdict = F.when(fits(r), F.lit(r[0] + r[1])).otherwise(name), F.when(fits(r), F.lit(r[2])).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), labelled: Iterable[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and p_block for ``pages`` (page_id, url).
    rules: (host, start of the path, verdict)."""
    weights, bias = train(labelled)

    def p_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in X.blocks(batch, "path"):
                p = chances(weights, bias, block.column("host").to_pylist(), block.column("path").to_pylist())
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(p)], [*block.schema.names, "p_block"])

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, whole, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(url, whole, 2).alias("path"))
    rule, fixed = _rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), fixed.alias("fixed")).mapInArrow(p_block, "page_id long, host string, path string, rule string, fixed string, p_block double")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
