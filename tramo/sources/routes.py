"""Where routed times and distances come from: a table, a rule, or a router over HTTP (through route_store, each pair is asked for once)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from http.client import HTTPConnection, HTTPException, HTTPSConnection
from typing import Protocol
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.functions import exprs as X

ROUTE_SCHEMA = "pair_key string, sec double, meters double"


class RouteProvider(Protocol):
    def routes(self, pairs: DataFrame) -> DataFrame:
        """pairs: pair_key, lat1, lon1, lat2, lon2. Gives pair_key, sec, meters; NULL where there is no route."""


@dataclass
class TableRoutes:
    table: DataFrame

    def routes(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("pair_key").join(self.table.select("pair_key", "sec", "meters"), "pair_key", "left")


@dataclass
class DetourRoutes:
    """Straight distance times a factor, at one speed."""

    detour: float = 1.3
    km_h: float = 30.0

    def routes(self, pairs: DataFrame) -> DataFrame:
        km = X.haversine_km(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))) * self.detour
        return pairs.select("pair_key", (km / self.km_h * 3600).alias("sec"), (km * 1000).alias("meters"))


class Session:
    """GET over one connection that is kept open for as long as the server allows; a task has its own."""

    def __init__(self, timeout: float = 4.0):
        self.timeout, self.to, self.connection = timeout, None, None

    def __call__(self, url: str) -> str:
        at = urlsplit(url)
        if self.connection is None or self.to != (at.scheme, at.netloc):
            kind = HTTPSConnection if at.scheme == "https" else HTTPConnection
            self.to, self.connection = (at.scheme, at.netloc), kind(at.netloc, timeout=self.timeout)
        try:
            self.connection.request("GET", f"{at.path}?{at.query}")
            with self.connection.getresponse() as r:
                body = r.read().decode()
                if r.status != 200:
                    raise OSError(f"status {r.status}")
                return body
        except (HTTPException, OSError) as broken:
            self.connection.close()
            self.connection = None
            raise OSError(str(broken)) from broken


def parse_route(body: str) -> tuple[float | None, float | None]:
    """Seconds and metres of the first route of a router's answer."""
    x = json.loads(body)
    if x.get("code") != "Ok" or not x.get("routes"):
        return None, None
    return x["routes"][0]["duration"], x["routes"][0]["distance"]


@dataclass
class HttpRoutes:
    """A router with the usual /route/v1/driving interface, asked by as many tasks as `workers`.

    By itself it is asked again by every action over its rows: StoredRoutes keeps the answers.
    """

    base: str
    workers: int = 16
    retries: int = 2
    pause: float = 0.3
    #: Makes what a task gets URLs with.
    session: Callable[[], Callable[[str], str]] = Session

    def answer(self, get: Callable[[str], str], lon1: float, lat1: float, lon2: float, lat2: float) -> tuple[float | None, float | None, str]:
        """Seconds, metres and status: a route, none, or failed if no try was answered."""
        url = f"{self.base}/route/v1/driving/{lon1},{lat1};{lon2},{lat2}?overview=false&alternatives=false&steps=false&radiuses=5000;5000"
        for k in range(self.retries + 1):
            try:
                sec, meters = parse_route(get(url))
                return sec, meters, "none" if sec is None else "route"
            except (OSError, ValueError, KeyError):
                time.sleep(self.pause * (k + 1))
        return None, None, "failed"

    def routes(self, pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            get = self.session()
            for b in batches:
                got = [self.answer(get, *row) for row in b[["lon1", "lat1", "lon2", "lat2"]].itertuples(index=False)]
                yield pd.DataFrame({"pair_key": b["pair_key"], "sec": [s for s, *_ in got], "meters": [m for _, m, _ in got]}).astype({"sec": float, "meters": float})

        return pairs.repartition(self.workers).mapInPandas(run, ROUTE_SCHEMA)
