"""Chunk corpora from pages: a model's answers are parsed, validated, repaired, else chunked plainly.

A client is a function from a prompt to a text. It runs inside the tasks; none is
shipped but a deterministic local one.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.udfs import json_object

MAX_CHUNK, MAX_CHUNKS, MAX_QA, REPAIRS = 1600, 40, 3, 3
# Seconds before each further try, and statuses that are worth one.
RETRY_DELAYS = (2, 4, 60, 600, 3600, 7200, 14400)
RETRY_STATUS = {408, 409, 425, 429, 500, 502, 503, 504}
Client = Callable[[str], str]


def local_client(prompt: str) -> str:
    """Splits the page after the prompt's rule into its paragraphs, neighbours together where they are too many."""
    page = prompt.split("\n---\n", 1)[-1]
    paragraphs = [p.strip() for p in page.split("\n\n") if p.strip()]
    each = max(1, -(-len(paragraphs) // MAX_CHUNKS))
    texts = ["\n\n".join(paragraphs[i : i + each]) for i in range(0, len(paragraphs), each)]
    chunks = [{"heading_path": [], "text": t, "summary": "", "keywords": [], "synonyms": [], "qa": []} for t in texts]
    return json.dumps({"chunks": chunks}, ensure_ascii=False)


def pooled(clients: Callable[[], dict[str, Client]], delays=(), **pool) -> Callable[[], Client]:
    """What generate() takes: in each task a ProviderPool over the clients, each tried again after the delays."""

    def make() -> Client:
        tried = {n: (lambda prompt, c=c: with_retry(lambda: c(prompt), delays)) for n, c in clients().items()}
        return ProviderPool(tried, **pool)

    return make


def _tight(s: str) -> str:
    import re

    return re.sub(r"\s*([.,;:()\[\]{}])\s*", r"\1", " ".join(s.split())).translate(str.maketrans("“”‘’«»", "\"\"''\"\""))


def problems(answer: dict | None, page: str) -> list[str]:
    """What is wrong with an answer: no object, no chunks, empty, long, many or not verbatim chunks."""
    if answer is None or not isinstance(answer.get("chunks"), list):
        return ["no JSON object with chunks"]
    chunks, out, whole = answer["chunks"], [], _tight(page)
    if not chunks:
        out.append("no chunks")
    if len(chunks) > MAX_CHUNKS:
        out.append(f"over {MAX_CHUNKS} chunks")
    for i, c in enumerate(chunks):
        text = c.get("text") if isinstance(c, dict) else None
        if not isinstance(text, str) or not text.strip():
            out.append(f"chunk {i} is empty")
        elif len(text) > 2 * MAX_CHUNK:
            out.append(f"chunk {i} is too long")
        elif _tight(text) not in whole:
            out.append(f"chunk {i} isn't in the page")
    return out


def generate_page(client: Client, page: str, repairs: int = REPAIRS) -> tuple[dict | None, list[str], int]:
    """(answer, problems, calls): the answer with the fewest problems of a call and its repairs."""
    best, wrong, said = None, None, ""
    for call in range(1 + repairs):
        prompt = "Split the page into chunks." if call == 0 else "Mend these problems: " + "; ".join(wrong or []) + "\n" + said
        said = client(f"{prompt}\n---\n{page}")
        got = json_object(said)
        found = problems(got, page)
        if wrong is None or len(found) < len(wrong):
            best, wrong = got, found
        if not found:
            break
    return best, wrong or [], call + 1


_ROW = "source string, chunk_idx int, text string, needs_regen boolean, problems string, calls int"


def generate(pages: DataFrame, make_client: Callable[[], Client] = lambda: local_client) -> DataFrame:
    """Chunks of pages (source, markdown). Pages without a usable answer are chunked plainly and flagged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            out = []
            for source, page in zip(pdf["source"], pdf["markdown"], strict=True):
                try:
                    answer, wrong, calls = generate_page(client, page)
                except Exception as e:  # no provider answered: the page is chunked plainly and done again later
                    answer, wrong, calls = None, [f"{type(e).__name__}: {e}"], 0
                if wrong:
                    out.append((source, None, page, True, "; ".join(wrong), calls))
                else:
                    out += [(source, i, c["text"], False, "", calls) for i, c in enumerate(answer["chunks"])]
            yield pd.DataFrame(out, columns=["source", "chunk_idx", "text", "needs_regen", "problems", "calls"]).astype({"chunk_idx": "Int32"})

    rows = pages.select("source", "markdown").mapInPandas(run, _ROW)
    plain = rows.where("needs_regen").select("source", F.posexplode(T.pack_paragraphs(F.col("text"))).alias("chunk_idx", "text"), "needs_regen", "problems", "calls")
    return rows.where("not needs_regen").unionByName(plain).withColumn("chunk_uid", T.chunk_uid(F.col("source"), F.col("chunk_idx")))


FLAVOURS = ("packed", "paragraphs", "whole")


def heuristic(pages: DataFrame, text: Column | None = None, flavour: str = "packed") -> DataFrame:
    """Chunks without a model, all flagged to be made anew: packed paragraphs, each paragraph, or the whole page."""
    text = F.col("markdown") if text is None else text
    if flavour not in FLAVOURS:
        raise ValueError(f"unknown flavour {flavour!r}, not one of {FLAVOURS}")
    paragraphs = F.filter(F.transform(F.split(text, "\n{2,}"), T.strip), lambda p: p != "")
    pieces = {"packed": T.pack_paragraphs(text), "paragraphs": paragraphs, "whole": F.filter(F.array(T.strip(text)), lambda p: p != "")}[flavour]
    out = pages.select("source", F.posexplode(pieces).alias("chunk_idx", "text"))
    return out.withColumns({"needs_regen": F.lit(True), "chunk_uid": T.chunk_uid(F.col("source"), F.col("chunk_idx"))})


def validated(raw: DataFrame) -> DataFrame:
    """Native validation of parsed answers (source, page, chunks array<struct<text, qa>>): flags and cut questions."""
    c = F.col("c")
    rows = raw.select("source", "page", F.size("chunks").alias("n"), F.posexplode("chunks").alias("chunk_idx", "c"))
    return rows.select(
        "source", "chunk_idx", c.text.alias("text"), F.slice(c.qa, 1, MAX_QA).alias("qa"),
        (T.strip(F.coalesce(c.text, F.lit(""))) != "").alias("non_empty"), (F.length(c.text) <= 2 * MAX_CHUNK).alias("fits"),
        (F.col("n") <= MAX_CHUNKS).alias("few"), F.contains(T.norm_verbatim(F.col("page")), T.norm_verbatim(c.text)).alias("verbatim"),
    )


def is_retriable(exc: BaseException) -> bool:
    status = getattr(exc, "status_code", None) or getattr(exc, "status", None)
    return status in RETRY_STATUS or isinstance(exc, (TimeoutError, ConnectionError))


def with_retry(call: Callable[[], str], delays=RETRY_DELAYS, sleep: Callable[[float], None] = time.sleep, jitter: float = 0.0) -> str:
    """The call's result, trying again after each delay as long as failures are worth it."""
    for delay in (*delays, None):
        try:
            return call()
        except Exception as e:
            if delay is None or not is_retriable(e):
                raise
            sleep(delay * (1 + jitter * random.random()))
    raise AssertionError


class ProviderPool:
    """Clients in order of preference. After so many failures in a row one rests, then is tried once."""

    def __init__(self, clients: dict[str, Client], failures: int = 12, rest: float = 180.0, clock: Callable[[], float] = time.monotonic):
        self.clients, self.most, self.rest, self.clock = clients, failures, rest, clock
        self.failed = dict.fromkeys(clients, 0)
        self.until = dict.fromkeys(clients, 0.0)

    def available(self) -> list[str]:
        return [n for n in self.clients if self.clock() >= self.until[n]]

    def __call__(self, prompt: str) -> str:
        last: Exception | None = None
        for name in self.available():
            try:
                out = self.clients[name](prompt)
            except Exception as e:
                last = e
                self.failed[name] += 1
                if self.failed[name] >= self.most:
                    self.until[name] = self.clock() + self.rest
                    self.failed[name] = self.most - 1  # one more failure after the rest is enough
                continue
            self.failed[name] = 0
            return out
        raise last or RuntimeError("no provider is available")
