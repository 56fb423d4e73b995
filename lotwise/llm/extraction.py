"""Main text of web pages by a tree-structured graphical model.

The elements of a page form a tree. Each has a hidden label, main text or not. A
label's potential depends on what the element shows (tag, names, text, links),
and parent-child potentials tie neighbours. Sum-product messages, upward then
downward, give the exact probability of every label; text blocks of elements
above one half are kept.

Potentials are trained by maximum likelihood on labelled pages: the pages in
``LABELLED`` and a bounded sample (``SAMPLE`` pages, by a hash of the page) of
those that declare their article in HTML, with boilerplate inside it named. The
learner sees these declarations only as features, like any other tag or name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.dom import features, parse

SAMPLE = 300
SHARDS = 4
ROUNDS = 3
RATE, DECAY = 0.3, 0.002
# Labelled pages: data-y marks main text (1) and what is not (0), also for all inside.
LABELLED = [
    "<html><body><header data-y=0><h1>Daily Site</h1><p>News for everyone.</p></header><nav data-y=0><a href=/>Home</a> <a href=/n>News</a></nav>"
    "<main data-y=1><h1>A title</h1><p>First paragraph of the story, with a comma.</p><p>Second one. It has <a href=x>a link</a> in it.</p>"
    "<ul><li>A point</li><li>Another point.</li></ul><blockquote><p>Quoted.</p></blockquote></main><aside data-y=0><h3>Read on</h3><p>Other stories, told elsewhere.</p></aside>"
    "<footer data-y=0><p>&copy; 2024 Daily Site. All rights reserved.</p></footer></body></html>",
    "<html><body><div class=menu data-y=0><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></div><div id=content data-y=1><h2>Head line</h2>"
    "<div class=ad data-y=0>Buy this now. Great price!</div><p>Text of the page that goes on for a while, and then some more.</p><p>Short.</p>"
    "<table><tr><td>Cell</td><td>12</td></tr></table></div><div class=sidebar data-y=0><p>About the author, who writes here.</p><div><a href=c>More</a></div></div>"
    "<div class=comments data-y=0><h3>Comments</h3><div class=comment><p>I liked this text, thank you.</p></div></div><div class=footer data-y=0>Contact. Imprint.</div></body></html>",
    "<html><body><div class='cookie notice' data-y=0><p>We use cookies to make this site better. <button>Ok</button></p></div><article data-y=1><header><h1>Story</h1></header>"
    "<p>It began on a day in spring.</p><aside data-y=0><p>Related: another long story about this.</p></aside><p>It ended well.</p>"
    "<form data-y=0><p>Subscribe to our letter.</p><label>Mail</label><input name=m></form><section><h2>Part</h2><p>Part two.</p></section></article>"
    "<section id=comments data-y=0><article><p>A reader writes a long remark about it all.</p></article></section></body></html>",
    "<html><body><div><div class=nav data-y=0><a href=1>a</a><a href=2>b</a></div><div class='post entry' data-y=1><p>Nothing but text here, two lines long.</p><pre>x = 1</pre>"
    "<div class=share data-y=0><a href=s>Share</a></div><p>End.</p></div><div class=related data-y=0><ul><li><a href=q>Other text</a></li></ul></div></div></body></html>",
    "<html><body><nav data-y=0><ul><li><a href=/x>x</a></li></ul></nav><div class=ad data-y=0>An advert in a sentence.</div><article data-y=1><h1>Title words</h1><p><b>Title words<br><p>Text one."
    "</p><p>Be.</p><div class=promo data-y=0><p>Special offer for you.</p></div></article><footer data-y=0>&copy; someone &middot; Some words. More words.</footer></body></html>",
]


def labels(nodes) -> list[int] | None:
    """Labels from marks, or from the one article a page declares; None if it doesn't."""
    marked = any(n.mark is not None for n in nodes)
    articles = [i for i, n in enumerate(nodes) if n.tag in ("article", "main") and not nodes[max(n.parent, 0)].within and not n.against]
    if not marked and len(articles) != 1:
        return None
    found = []
    for i, n in enumerate(nodes):
        above = found[n.parent] if n.parent >= 0 else 0
        if marked:
            found.append(above if n.mark is None else int(n.mark))
        else:
            found.append(0 if n.against else 1 if i == articles[0] else above)
    return found


class Potentials:
    """Weights of features for label 1, and the four parent-child weights."""

    def __init__(self, weights: dict[str, float] | None = None, ties: np.ndarray | None = None):
        self.weights = weights or {}
        self.ties = np.zeros((2, 2)) if ties is None else ties

    def marginals(self, nodes, shown) -> tuple[list[float], list[tuple[float, float, float, float]]]:
        """Probability of label 1 of each node; of (parent, child) labels 00, 01, 10, 11."""
        get, n = self.weights.get, len(nodes)
        (t00, t01), (t10, t11) = self.ties.tolist()
        exp, log = math.exp, math.log
        score = [sum(get(f, 0.0) for f in own) for own in shown]  # log odds, with all messages from below
        up = [0.0] * n  # log odds that a node sends to its parent

        def soft(a, b):
            return (a + log(1 + exp(b - a))) if a > b else (b + log(1 + exp(a - b)))

        for i in range(n - 1, 0, -1):
            s = score[i]
            up[i] = soft(t10, t11 + s) - soft(t00, t01 + s)
            score[nodes[i].parent] += up[i]
        belief = score[:]  # log odds with the message from above
        pairs = [(0.0, 0.0, 0.0, 0.0)] * n
        for i in range(1, n):
            rest = belief[nodes[i].parent] - up[i]
            s = score[i]
            a, b, c, d = t00, t01 + s, t10 + rest, t11 + rest + s
            top = max(a, b, c, d)
            a, b, c, d = exp(a - top), exp(b - top), exp(c - top), exp(d - top)
            total = a + b + c + d
            pairs[i] = (a / total, b / total, c / total, d / total)
            belief[i] = log(max(b + d, 1e-300)) - log(max(a + c, 1e-300))
        return [1 / (1 + exp(-min(max(x, -700), 700))) for x in belief], pairs


def _learn(start: Potentials, own_pages: list[str]):
    """One pass of stochastic gradient over the labelled pages of a shard."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        model = Potentials(dict(start.weights), start.ties.copy())
        sums: dict[str, float] = {}
        tie_sums = np.full((2, 2), 1e-2)
        for page in [*rows["html"].dropna(), *own_pages]:
            nodes, _ = parse(page)
            true = labels(nodes)
            if true is None:
                continue
            shown = features(nodes)
            found, pairs = model.marginals(nodes, shown)
            gradient: dict[str, float] = {}
            for own, y, p in zip(shown, true, found):
                for f in own:
                    gradient[f] = gradient.get(f, 0.0) + y - p
            tie = np.zeros((2, 2))
            for i in range(1, len(nodes)):
                tie[true[nodes[i].parent], true[i]] += 1
                tie -= np.array(pairs[i]).reshape(2, 2)
            for f, g in gradient.items():
                sums[f] = sums.get(f, 1e-2) + g * g
                old = model.weights.get(f, 0.0)
                model.weights[f] = old + RATE * (g / math.sqrt(sums[f]) - DECAY * old)
            tie_sums += tie * tie
            model.ties += RATE * (tie / np.sqrt(tie_sums) - DECAY * model.ties)
        names = [*model.weights, *[f"#{i}" for i in range(4)]]
        return pd.DataFrame({"name": names, "weight": [*model.weights.values(), *model.ties.ravel()]})

    return learn


def train(pages: DataFrame, sample: int = SAMPLE) -> Potentials:
    """Fit potentials; without declaring pages in the table, on ``LABELLED`` alone.

    Pages are drawn and dealt to shards by a hash of page_id and html, so copies of a
    page are drawn like any pages. Shards of the sample start each round from the same
    weights, which are then averaged. The driver gets one row per feature.
    """
    declaring = pages.where("html RLIKE '(?i)<(article|main)[ >]'").select("page_id", "html")
    rate = min(1.0, sample / max(declaring.count(), 1))
    chosen = declaring.where(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30)) < rate * (1 << 30))
    shards = chosen.withColumn("shard", F.pmod(F.xxhash64("page_id", "html", F.lit(3)), F.lit(SHARDS)))
    seeds = pages.sparkSession.range(SHARDS).selectExpr("CAST(NULL AS STRING) AS html", "id AS shard")
    shards = shards.select("html", "shard").unionByName(seeds)
    model = Potentials()
    for _ in range(ROUNDS):
        learned = shards.groupBy("shard").applyInPandas(_learn(model, LABELLED * 6), "name STRING, weight DOUBLE")
        mean = {r["name"]: r["w"] for r in learned.groupBy("name").agg((F.sum("weight") / SHARDS).alias("w")).collect()}
        ties = np.array([mean.pop(f"#{i}") for i in range(4)]).reshape(2, 2)
        model = Potentials(mean, ties)
    return model


def main_text(page: str, model: Potentials) -> str:
    nodes, blocks = parse(page)
    found, _ = model.marginals(nodes, features(nodes))
    return " ".join(text for own, text in blocks if found[own] > 0.5)


def extract(pages: DataFrame, model: Potentials) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null html gives empty text."""
    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    chosen = pages.select("page_id", "url", "html")

    def task(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, 200):
                own = rows.slice(at, 200)
                texts = [main_text(page, model) if page else "" for page in own["html"].to_pylist()]
                columns = [own["page_id"], own["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return chosen.mapInArrow(task, f"page_id {kinds['page_id']}, url {kinds['url']}, text STRING, n_chars BIGINT")
