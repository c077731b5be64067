"""Queries as jobs: submit, status, cancel, timeout."""

from __future__ import annotations

import enum
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class QueryState(enum.Enum):
    PREPARING = "preparing"
    PLANNING = "planning"
    RUNNING = "running"
    COMPLETED = "completed"  # all rows are made, not all are taken
    FINISHED = "finished"
    CANCELLED = "cancelled"
    TIMEOUT = "timeout"
    ERROR = "error"


TERMINAL = frozenset({QueryState.FINISHED, QueryState.CANCELLED, QueryState.TIMEOUT, QueryState.ERROR})


class QueryStopped(RuntimeError):
    """The query was cancelled, or its time is over."""


@dataclass
class QueryHandle:
    """One submitted query. result and error are set once it has ended."""

    query_id: str
    state: QueryState = QueryState.PREPARING
    submitted: float = field(default_factory=time.time)
    ended: float | None = None
    result: object = None
    plan: object = None
    error: BaseException | None = None
    done: threading.Event = field(default_factory=threading.Event, repr=False)
    left: threading.Event = field(default_factory=threading.Event, repr=False)  # the work's thread has ended
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def move(self, state: QueryState) -> bool:
        """Enter a state; False where the query has ended already."""
        with self.lock:
            if self.state in TERMINAL:
                return False
            self.state = state
            if state in TERMINAL:
                self.ended = time.time()
            if state in TERMINAL or state is QueryState.COMPLETED:
                self.done.set()
            return True

    def check(self) -> None:
        """Raise QueryStopped where the query has been cancelled or timed out; work calls it between its steps."""
        if self.state in TERMINAL:
            raise QueryStopped(f"query {self.query_id} is {self.state.value}")

    def taken(self) -> bool:
        """A reader has all it wants of a completed query."""
        return self.move(QueryState.FINISHED)

    def wait(self, seconds: float | None = None) -> QueryState:
        """Until the query is COMPLETED or has ended."""
        self.done.wait(seconds)
        return self.state


class QueryManager:
    """Runs queries in threads; each query's Spark jobs bear its id as a tag, by which they are stopped.

    Of ended queries the last `keep` are remembered.
    """

    def __init__(self, spark: SparkSession, keep: int = 1000) -> None:
        self.spark, self.keep = spark, keep
        self.queries: dict[str, QueryHandle] = {}

    def list(self, state: QueryState | None = None) -> list[QueryHandle]:
        return [q for q in self.queries.values() if state in (None, q.state)]

    def get(self, query_id: str) -> QueryHandle:
        if query_id not in self.queries:
            raise KeyError(f"no query {query_id!r}")
        return self.queries[query_id]

    def forget(self) -> None:
        """Drop the oldest ended queries beyond `keep`."""
        ended = sorted((q for q in self.queries.values() if q.state in TERMINAL and q.left.is_set()), key=lambda q: q.ended)
        for handle in ended[: max(0, len(ended) - self.keep)]:
            del self.queries[handle.query_id]

    def submit(self, work: Callable[[QueryHandle], object], query_id: str | None = None, timeout: float | None = None, completes: bool = False) -> QueryHandle:
        """Start work(handle) and return at once. What it returns is the handle's result; the query ends as FINISHED, or with `completes` is COMPLETED until
        a reader calls taken(). timeout, in seconds, stops it, also while it waits for that reader."""
        self.forget()
        handle = QueryHandle(query_id or uuid.uuid4().hex)
        if handle.query_id in self.queries:
            raise ValueError(f"query {handle.query_id!r} exists")
        self.queries[handle.query_id] = handle
        timer = threading.Timer(timeout, self._stop, (handle, QueryState.TIMEOUT)) if timeout else None

        def run() -> None:
            self.spark.sparkContext.addJobTag(handle.query_id)
            try:
                if handle.move(QueryState.RUNNING):
                    handle.result = work(handle)
                    handle.move(QueryState.COMPLETED if completes else QueryState.FINISHED)
            except BaseException as error:  # the thread's end must be seen whatever it was
                handle.error = error
                handle.move(QueryState.ERROR)
            finally:
                self.spark.sparkContext.removeJobTag(handle.query_id)
                handle.left.set()
                if timer and handle.state in TERMINAL:
                    timer.cancel()

        if timer:
            timer.daemon = True
            timer.start()
        thread = InheritableThread(target=run)
        thread.daemon = True
        thread.start()
        return handle

    def cancel(self, query_id: str) -> QueryHandle:
        handle = self.get(query_id)
        self._stop(handle, QueryState.CANCELLED)
        return handle

    def _stop(self, handle: QueryHandle, state: QueryState) -> None:
        """End the query and interrupt its jobs, also those that its thread starts until it ends."""
        if not handle.move(state):
            return

        context = self.spark.sparkContext

        def interrupt() -> None:
            while not context._jsc.sc().isStopped():
                context.cancelJobsWithTag(handle.query_id)
                if handle.left.wait(0.2):
                    return

        threading.Thread(target=interrupt, daemon=True).start()
