"""Sessions: results by handle, named results that outlive the session, and coordination of several clients."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.errors import AlreadyMaterialized, CorpusError, CouplerCycle, IncompatibleCoupler, NameInUse, PageTooLarge, StaleQuery, UnknownClient, UnknownCoupler, UnknownHandle, UnknownName, UnknownTopic, UnsupportedCoupler
from corpusq.functions import files
from corpusq.functions.storage import written
from corpusq.model import Corpus
from corpusq.operators import navigation
from corpusq.operators.paging import page, ranked
from corpusq.plans.compiler import run

PAGE_LIMIT = 1000


@dataclass
class Result:
    handle: str
    query: str
    hits: DataFrame  # ranked, in a written table
    count: int
    form: str = "session"
    name: str | None = None
    materialized: bool = False


class Results:
    """Queries run once; their ranked hits lie in the shared folder and are read by page. Named results are kept as query
    and count in a file that is replaced as a whole, and run again when asked for in a later session."""

    def __init__(self, corpus: Corpus, state_dir: str | None = None):
        self.corpus, self.file = corpus, state_dir and files.join(state_dir, "named_results.jsonl")
        self.results: dict[str, Result] = {}
        self.named: dict[str, dict] = {}
        self.on_change: list[Callable[[str, str], None]] = []
        if self.file and files.exists(corpus.spark, self.file):
            self.named = {r["name"]: r for r in map(json.loads, files.read_text(corpus.spark, self.file).splitlines())}

    def execute(self, query: str, handle: str | None = None) -> Result:
        hits = written(ranked(run(self.corpus, query)), "result")
        r = Result(handle or f"r-{uuid.uuid4()}", query, hits, hits.count())
        self.results[r.handle] = r
        return r

    def execute_count(self, query: str) -> int:
        return run(self.corpus, query).count()

    def _get(self, handle: str) -> Result:
        if handle not in self.results:
            raise UnknownHandle(handle)
        return self.results[handle]

    def hits(self, handle: str, offset: int = 0, limit: int = PAGE_LIMIT) -> tuple[DataFrame, int]:
        """Hits offset .. offset + limit in order, and the number of all."""
        if limit > PAGE_LIMIT:
            raise PageTooLarge(f"{limit} > {PAGE_LIMIT}")
        r = self._get(handle)
        return page(r.hits, offset, limit), r.count

    def metadata(self, handle: str) -> dict:
        r = self._get(handle)
        return {"handle": r.handle, "query": r.query, "count": r.count, "form": r.form, "name": r.name, "materialized": r.materialized}

    def save(self, handle: str, name: str) -> dict:
        r = self._get(handle)
        if name in self.named:
            raise NameInUse(name)
        self._keep({**self.named, name: {"name": name, "handle": handle, "query": r.query, "count": r.count, "saved_at": datetime.now(UTC).isoformat()}})
        r.form, r.name = "query_backed", name
        self._tell("saved", name)
        return self.metadata(handle)

    def materialize(self, name: str) -> dict:
        r = self._get(self._named(name)["handle"])
        if r.materialized:
            raise AlreadyMaterialized(name)
        r.materialized, r.form = True, "materialized"
        return self.metadata(r.handle)

    def load(self, name: str) -> dict:
        """The result of that name; one of an earlier session is run again under its handle."""
        kept = self._named(name)
        if kept["handle"] not in self.results:
            try:
                r = self.execute(kept["query"], kept["handle"])
            except CorpusError as e:
                raise StaleQuery(f"{name}: {e}") from e
            r.form, r.name = "query_backed", name
        return self.metadata(kept["handle"])

    def list_named(self) -> list[dict]:
        return [self.named[n] for n in sorted(self.named)]

    def delete_named(self, name: str) -> None:
        self._named(name)
        self._keep({k: v for k, v in self.named.items() if k != name})
        for r in self.results.values():
            if r.name == name:
                r.name, r.form = None, "session"
        self._tell("deleted", name)

    def discard(self, handle: str) -> None:
        """Forget a session result; named and unknown ones are left alone."""
        r = self.results.get(handle)
        if r is not None and r.name is None:
            del self.results[handle]

    def _named(self, name: str) -> dict:
        if name not in self.named:
            raise UnknownName(name)
        return self.named[name]

    def _keep(self, named: dict[str, dict]) -> None:
        if self.file:
            files.make_dir(self.corpus.spark, files.parent(self.file))
            files.write_text(self.corpus.spark, self.file, "".join(json.dumps(r) + "\n" for r in named.values()))
        self.named = named

    def _tell(self, event: str, name: str) -> None:
        for f in self.on_change:
            f(event, name)


#: What kinds of interest a coupler takes and gives.
COUPLERS = {
    "sentence_mirror": ({"position", "span", "sentence"}, {"sentence"}),
    "alignment": ({"sentence", "span"}, {"span"}),
    "kwic_selection": ({"hit"}, {"span"}),
    "doc_picker_selection": ({"document"}, {"document"}),
    "named_results_selection": ({"results"}, {"results"}),
    "conllu_view": ({"sentence"}, {"sentence"}),
}
TOPICS = ("roster_changed", "named_results_changed")


@dataclass
class Client:
    id: int
    kind: str
    label: str | None
    provides: frozenset[str]
    consumes: frozenset[str]
    notify: Callable[[str, dict], None]
    interest: dict | None = None


@dataclass
class Coupler:
    id: int
    master: int
    follower: int
    kind: str
    alignment: str | None = None


@dataclass
class Session:
    """Clients of one corpus; an interest is a dict with kind and fields (doc, sent, position, start, end, result, hit)."""

    corpus: Corpus
    state_dir: str | None = None
    clients: dict[int, Client] = field(default_factory=dict)
    couplers: dict[int, Coupler] = field(default_factory=dict)
    topics: dict[str, set[int]] = field(default_factory=lambda: {t: set() for t in TOPICS})
    _next: list[int] = field(default_factory=lambda: [1, 1])

    def __post_init__(self) -> None:
        self.results = Results(self.corpus, self.state_dir)
        self.results.on_change.append(lambda event, name: self._publish("named_results_changed", {"event": event, "name": name}))

    def _publish(self, topic: str, message: dict) -> None:
        for c in sorted(self.topics[topic]):
            self.clients[c].notify(topic, message)

    def _client(self, i: int) -> Client:
        if i not in self.clients:
            raise UnknownClient(str(i))
        return self.clients[i]

    def register(self, kind: str, notify: Callable[[str, dict], None], provides=(), consumes=(), label: str | None = None) -> int:
        i, self._next[0] = self._next[0], self._next[0] + 1
        self.clients[i] = Client(i, kind, label, frozenset(provides), frozenset(consumes), notify)
        self._publish("roster_changed", {"event": "registered", "client": i})
        return i

    def unregister(self, i: int) -> None:
        if self.clients.pop(i, None) is None:
            return
        self.couplers = {k: c for k, c in self.couplers.items() if i not in (c.master, c.follower)}
        for members in self.topics.values():
            members.discard(i)
        self._publish("roster_changed", {"event": "unregistered", "client": i})

    def update_label(self, i: int, label: str | None) -> None:
        self._client(i).label = label
        self._publish("roster_changed", {"event": "label_updated", "client": i})

    def roster(self, kinds=(), provides_any=(), consumes_any=()) -> list[Client]:
        """Clients that meet every given filter; a filter is met by any of its members."""
        wanted = ((lambda c: {c.kind}, kinds), (lambda c: c.provides, provides_any), (lambda c: c.consumes, consumes_any))
        return [c for c in self.clients.values() if all(not w or set(w) & get(c) for get, w in wanted)]

    def subscribe(self, i: int, topic: str) -> None:
        if topic not in self.topics:
            raise UnknownTopic(topic)
        self._client(i)
        self.topics[topic].add(i)

    def unsubscribe(self, i: int, topic: str) -> None:
        if topic not in self.topics:
            raise UnknownTopic(topic)
        self.topics[topic].discard(i)

    def couple(self, master: int, follower: int, kind: str, alignment: str | None = None) -> int:
        """The follower gets what the master is interested in, transformed; at once if there is something."""
        if kind not in COUPLERS:
            raise UnsupportedCoupler(kind)
        a, b = self._client(master), self._client(follower)
        if self._reaches(follower, master):
            raise CouplerCycle(f"{master} -> {follower}")
        takes, gives = COUPLERS[kind]
        if not takes & a.provides or not gives & b.consumes:
            raise IncompatibleCoupler(f"{kind}: {sorted(a.provides)} -> {sorted(b.consumes)}")
        i, self._next[1] = self._next[1], self._next[1] + 1
        self.couplers[i] = Coupler(i, master, follower, kind, alignment)
        if a.interest is not None:
            self._push(self.couplers[i], a.interest)
        return i

    def _reaches(self, start: int, goal: int) -> bool:
        seen, queue = set(), [start]
        while queue:
            at = queue.pop()
            if at == goal:
                return True
            if at not in seen:
                seen.add(at)
                queue += [c.follower for c in self.couplers.values() if c.master == at]
        return False

    def uncouple(self, i: int) -> None:
        if self.couplers.pop(i, None) is None:
            raise UnknownCoupler(str(i))

    def coupled(self, client: int | None = None) -> list[Coupler]:
        return [c for c in self.couplers.values() if client is None or client in (c.master, c.follower)]

    def publish_interest(self, i: int, interest: dict) -> None:
        """What a client looks at now; kinds that it didn't say it provides are ignored."""
        c = self.clients.get(i)
        if c is None or interest["kind"] not in c.provides:
            return
        c.interest = interest
        for k in [k for k in self.couplers.values() if k.master == i]:
            self._push(k, interest)

    def _push(self, k: Coupler, interest: dict) -> None:
        for x in self.transform(k, interest):
            self.clients[k.follower].notify("coupler_update", {"coupler": k.id, "interest": x})

    def transform(self, k: Coupler, interest: dict) -> list[dict]:
        if interest["kind"] not in COUPLERS[k.kind][0]:
            return []
        return {"sentence_mirror": self._mirror, "alignment": self._aligned, "kwic_selection": self._selected}.get(k.kind, lambda k, x: [])(k, interest)

    def _mirror(self, k: Coupler, x: dict) -> list[dict]:
        if x["kind"] == "sentence":
            return [x]
        pos = x["position"] if x["kind"] == "position" else x["start"]
        s = self.corpus.sentences.where((F.col("doc_idx") == x["doc"]) & (F.col("start_pos") <= pos) & (F.col("end_pos") > pos)).select("sent_in_doc").first()
        return [{"kind": "sentence", "doc": x["doc"], "sent": s.sent_in_doc}] if s else []

    def _aligned(self, k: Coupler, x: dict) -> list[dict]:
        if x["kind"] == "sentence":
            s = navigation.sentence(self.corpus, x["doc"], x["sent"]).select("start_pos", "end_pos").first()
            if s is None:
                return []
            start, end = s
        else:
            start, end = x["start"], x["end"]
        try:
            targets = navigation.project_range(self.corpus, k.alignment, x["doc"], start, end)
        except CorpusError:
            return []
        return [{"kind": "span", "doc": t.doc_idx, "start": t.start_pos, "end": t.end_pos} for t in targets.collect()]  # the targets of one range

    def _selected(self, k: Coupler, x: dict) -> list[dict]:
        r = self.results.results.get(x["result"])
        hit = r and page(r.hits, x["hit"], 1).first()
        return [{"kind": "span", "doc": hit.doc_idx, "start": hit.start_pos, "end": hit.end_pos}] if hit else []
