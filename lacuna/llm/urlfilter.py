"""URL filters: glob rules packed into multiword Shift-And masks and run over all URLs of a batch at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.rows import map_rows

# Rules with a name: (verdict, host, path). A rule holds for its host and all subdomains (fixed values).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# What is blocked where no named rule fits: globs over the host, and over the path (fixed values).
BLOCKED_HOSTS = (
    "*casino*", "*pills*", "*bets*", "*spam*", "*porn*", "*viagra*", "*poker*", "*warez*", "*torrent*", "*malware*", "*phish*", "*escort*",
    "ad.*", "ads.*", "adserver.*", "banner.*", "banners.*", "click.*", "doubleclick.*", "pixel.*", "track.*", "tracker.*", "tracking.*",
)
BLOCKED_PATHS = (
    "*/wp-login.php", "*/wp-admin/*", "*/xmlrpc.php", "*/cgi-bin/*", "*/login", "*/login/*", "*/signin", "*/signin/*", "*/cart/*", "*/checkout/*",
    "*.apk", "*.css", "*.exe", "*.gif", "*.ico", "*.iso", "*.jpeg", "*.jpg", "*.js", "*.mp3", "*.mp4", "*.png", "*.svg", "*.zip",
)

OTHER, SEP, PAD = 128, 129, 130
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: URLs that advance together, characters from which one is walked by itself, and states that are remembered for that.
GROUP, LONG, STATES = 512, 2048, 10_000
#: Globs that a table of them may hold, and those of one automaton; more make several.
MOST_GLOBS, GLOBS = 100_000, 4_096


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path). Null or no ``://``: both empty."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    stops = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(stops, default=len(rest))
    tail = rest[cut:]
    ends = [i for i in map(tail.find, "?#") if i >= 0]
    return rest[:cut].translate(_UPPER), tail[: min(ends, default=len(tail))]


@dataclass
class Automaton:
    """step[c]: states that character c enters; loop[c]: states that it may stay in; ends: (word, bit) of each glob.

    Characters beyond ASCII that the globs name are in others, in order, and have the codes after PAD; all further ones are OTHER.
    """

    step: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    ends: list[tuple[int, int]]
    others: np.ndarray

    def codes(self, text: str) -> np.ndarray:
        """The code of each character of a host or path."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        out = np.minimum(c, OTHER).astype(np.uint16)
        if len(self.others) and (far := c >= OTHER).any():
            at = np.minimum(np.searchsorted(self.others, c), len(self.others) - 1)
            out = np.where(far & (self.others[at] == c), PAD + 1 + at, out).astype(np.uint16)
        return out

    def code(self, host: str, path: str) -> np.ndarray:
        return np.concatenate([self.codes(host), np.array([SEP], np.uint16), self.codes(path)])


def compile_globs(globs: list[tuple[str, str]]) -> Automaton:
    """Globs (host, path): ``*`` is any run and ``?`` any one character of its part; neither crosses the parts.

    All globs lie one after another in one row of bits, a state for each literal and one for the start.
    """
    total = sum(1 + len([c for c in h + p if c != "*"]) + 1 for h, p in globs)
    words = -(-total // 64)
    others = sorted({ord(c) for h, p in globs for c in h + p if ord(c) >= OTHER})
    size = PAD + 1 + len(others)
    step, loop = np.zeros((size, words), np.uint64), np.zeros((size, words), np.uint64)
    start, ends, at = np.zeros(words, np.uint64), [], 0
    loop[PAD] = ~np.uint64(0)
    inside = [c for c in range(size) if c not in (SEP, PAD)]
    named = {chr(c): PAD + 1 + k for k, c in enumerate(others)}

    def put(table: np.ndarray, codes, bit: int) -> None:
        table[codes, bit >> 6] |= np.uint64(1 << (bit & 63))

    for host, path in globs:
        start[at >> 6] |= np.uint64(1 << (at & 63))
        for c in [*host, SEP, *path]:
            if c == "*":
                put(loop, inside, at)
                continue
            at += 1
            put(step, inside if c == "?" else c if c == SEP else named.get(c) or ord(c), at)
        ends.append((at >> 6, at & 63))
        at += 1
    return Automaton(step, loop, start, ends, np.array(others, np.uint32))


def last_states(auto: Automaton, texts: list[tuple[str, str]]) -> np.ndarray:
    """(URL, word): the states after the whole of each (host, path).

    URLs under LONG characters advance together, so a step's memory is GROUP states and a grid's is GROUP
    times LONG codes; a longer one is walked by itself.
    """
    codes = [auto.code(host, path) for host, path in texts]
    last = np.zeros((len(texts), len(auto.start)), np.uint64)
    order = sorted((i for i in range(len(codes)) if len(codes[i]) < LONG), key=lambda i: len(codes[i]))
    for a in range(0, len(order), GROUP):
        rows = order[a : a + GROUP]
        grid = np.full((len(codes[rows[-1]]), len(rows)), PAD, np.uint16)
        for k, i in enumerate(rows):
            grid[: len(codes[i]), k] = codes[i]
        state = np.repeat(auto.start[None, :], len(rows), axis=0)
        for c in grid:
            state = advance(auto, state, c)
        last[rows] = state
    walker = Walker(auto)
    for i, code in enumerate(codes):
        if len(code) >= LONG:
            last[i] = walker.walk(code)
    return last


def simulate(auto: Automaton, texts: list[tuple[str, str]]) -> np.ndarray:
    """Boolean matrix (URL, glob): which globs match the whole of (host, path)."""
    last = last_states(auto, texts)
    out = np.zeros((len(texts), len(auto.ends)), bool)
    for g, (word, bit) in enumerate(auto.ends):
        out[:, g] = (last[:, word] >> np.uint64(bit)) & np.uint64(1)
    return out


def matches_any(autos: list[Automaton], texts: list[tuple[str, str]]) -> np.ndarray:
    """Whether any glob of any of the automata matches each URL. URLs go by GROUP, so memory is that of one automaton's states."""
    out = np.zeros(len(texts), bool)
    for auto in autos:
        ends = np.zeros(len(auto.start), np.uint64)
        for word, bit in auto.ends:
            ends[word] |= np.uint64(1 << bit)
        for a in range(0, len(texts), GROUP):
            out[a : a + GROUP] |= (last_states(auto, texts[a : a + GROUP]) & ends).any(1)
    return out


def advance(auto: Automaton, state: np.ndarray, c: np.ndarray) -> np.ndarray:
    """States of all rows after one character each."""
    moved = state << np.uint64(1)
    moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
    return (moved & auto.step[c]) | (state & auto.loop[c])


class Walker:
    """The automaton over one long URL: what follows a set of states on each character is worked out once and remembered."""

    def __init__(self, auto: Automaton):
        self.auto, self.numbers, self.states, self.after = auto, {}, [], []

    def number(self, state: np.ndarray) -> int:
        k = self.numbers.setdefault(state.tobytes(), len(self.states))
        if k == len(self.states):
            self.states.append(state)
            self.after.append([-1] * len(self.auto.step))
        return k

    def walk(self, code: np.ndarray) -> np.ndarray:
        now = self.number(self.auto.start)
        for c in code.tolist():
            then = self.after[now][c]
            if then < 0:
                state = advance(self.auto, self.states[now][None, :], np.array([c]))[0]
                if len(self.states) >= STATES:
                    self.numbers, self.states, self.after = {}, [], []
                    then = self.number(state)
                else:
                    then = self.after[now][c] = self.number(state)
            now = then
        return self.states[now]


def globs_of(table: DataFrame, host_col: str = "host", path_col: str = "path") -> list[tuple[str, str]]:
    """(host, path) globs of a table, which may hold MOST_GLOBS rows; null stands for any."""
    rows = table.select(F.coalesce(host_col, F.lit("*")), F.coalesce(path_col, F.lit("*"))).distinct().limit(MOST_GLOBS + 1).collect()
    if len(rows) > MOST_GLOBS:
        raise ValueError(f"more than {MOST_GLOBS} globs")
    return sorted(map(tuple, rows))


BLOCKED = tuple((h, "*") for h in BLOCKED_HOSTS) + tuple(("*", p) for p in BLOCKED_PATHS)


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages.

    rule is the longest named rule that fits (the earlier one of equal lengths), else null. Without one
    the verdict is block if a blocked (host, path) glob matches (globs_of takes them from a table) or the
    host is empty (null, empty or malformed url), else allow. Repeated rows repeat; other columns are not read; an empty table gives no rows.
    """
    names = [h + p for _, h, p in rules]

    def make():
        auto = compile_globs([g for _, h, p in rules for g in ((h, p + "*"), ("*." + h, p + "*"))])
        block = [compile_globs(list(blocked[a : a + GLOBS])) for a in range(0, len(blocked), GLOBS)]
        best = sorted(range(len(rules)), key=lambda i: (-len(names[i]), i))

        def each(rows):
            parts = [canonical(u) for u in rows["url"]]
            named = simulate(auto, parts).reshape(len(parts), len(rules), 2).any(2)
            bad = matches_any(block, parts)
            out = {"page_id": rows["page_id"], "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [], "verdict": []}
            for i, (host, _) in enumerate(parts):
                k = next((r for r in best if named[i, r]), None)
                out["rule"].append(None if k is None else names[k])
                out["verdict"].append(rules[k][0] if k is not None else "block" if bad[i] or not host else "allow")
            return out

        return each

    cols = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")]
    return map_rows(pages.select(*cols), make, "page_id long, host string, path string, rule string, verdict string")
