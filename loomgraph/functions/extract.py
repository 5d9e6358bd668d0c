"""What a text says of other things: references, closing words, duplicates, paths, error signatures, claims, releases.

Every extractor is a plain function of one text, and one Arrow-batched column for all rows; the columns are null-safe and only
texts that hold a mark at all (`#`, a slash, a fence) need to reach Python, which callers filter for in the JVM.
Quoted material doesn't count: fenced code, inline code, diff hunks, quoted lines, other repositories' references. It is blanked
by as many spaces, so offsets stay those of the text as it is stored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: The forge's host, the closing and duplicate words, the longest reference (digits), the longest one in claims.
FORGE = r"https?://github\.com/"
CLOSES = r"(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?):?"
DUPLICATES = r"(?:duplicates?|duplicated|dup)"
DIGITS, CLAIM_DIGITS = 10, 9
#: Who may claim, what a claim says, how a release begins, hours that a claim holds.
TRUSTED = ("OWNER", "MEMBER", "COLLABORATOR")
CLAIM_WORDS, RELEASE, WINDOW_HOURS = ("Agent claim", "Working this issue"), "**Claim released", 72
TOKEN = re.compile(r"session=([A-Za-z0-9-]{16,64})(?![A-Za-z0-9-])")
#: Fixed patterns of error lines and Python frames.
ERROR = re.compile(r"^\s*([A-Za-z_][A-Za-z0-9_]*(?:Error|Exception|Interrupt|Exit|Warning|Failure|Fault))\b\s*:?\s*(.*)$")
FRAME = re.compile(r'File "([^"\n]+)", line \d+(?:, in ([A-Za-z_][\w.]*))?')


def _blank(chars: list[str], lo: int, hi: int) -> None:
    chars[lo:hi] = " " * (hi - lo)


def without_foreign(text: str, repo: str) -> str:
    """The text with references to other repositories blanked."""
    chars, own = list(text), repo.lower()
    for m in re.finditer(FORGE + r"([\w.-]+/[\w.-]+)/(?:issues|pull)/\d+", text, re.IGNORECASE):
        if m.group(1).lower() != own:
            _blank(chars, *m.span())
    for m in re.finditer(r"(?<![\w./-])([\w./-]{1,199})(#\d+)\b", text):
        owner, slash, name = m.group(1).partition("/")
        if slash and owner and name and "/" not in name and m.group(1).lower() != own:
            _blank(chars, *m.span())
    return "".join(chars)


def code_spans(line: str) -> list[tuple[int, int]]:
    """Inline code: a run of backticks, up to the next run that is as long at least."""
    runs, out, p = [m.span() for m in re.finditer("`+", line)], [], 0
    while p < len(runs):
        size = runs[p][1] - runs[p][0]
        q = next((q for q in range(p + 1, len(runs)) if runs[q][1] - runs[q][0] >= size), None)
        if q is not None:
            out.append((runs[p][0], runs[q][1]))
        p = p + 1 if q is None else q + 1
    return out


def without_quotes(text: str) -> str:
    """The text with fenced code, inline code, diff hunks and quoted lines blanked."""
    chars, at, fence, hunk = list(text), 0, "", False
    for line in text.splitlines(keepends=True):
        end, bare = at + len(line), line.lstrip()
        mark = re.match("`{3,}|~{3,}", bare)
        noise = True
        if mark:
            hunk = False
            if not fence:
                fence = mark.group()
            elif mark.group()[0] == fence[0] and len(mark.group()) >= len(fence):
                fence = ""
        elif fence:
            pass
        elif re.match("@@ .* @@", bare):
            hunk = True
        elif not (hunk and bare[:1] in ("+", "-", " ")):
            hunk, noise = False, bare.startswith(">")
        if noise:
            _blank(chars, at, end)
        for lo, hi in code_spans(line):
            _blank(chars, at + lo, at + hi)
        at = end
    return "".join(chars)


def _is_noise(plain: str, at: int, repo: str) -> bool:
    """Whether the token at this place is a comment's id or belongs to another repository named before it."""
    while at and plain[at - 1].isspace():
        at -= 1
    before = plain[max(0, at - 300) : at]
    if re.search(r"(?<!\w)comment$", before, re.IGNORECASE):
        return True
    slug = re.search(r"([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)$", before)
    return bool(slug) and slug.group().lower() != repo.lower()


def _forms(repo: str, lead: str = "") -> list[re.Pattern]:
    own, number = re.escape(repo), rf"(\d{{1,{DIGITS}}})\b"
    bare = "#" if lead else r"(?<![A-Za-z0-9._-])#"
    return [re.compile(f"(?i){lead}{form}{number}") for form in (f"{FORGE}{own}/(?:issues|pull)/", f"{own}#", bare)]


def references_of(text: str | None, repo: str) -> list[tuple[str, int, int]]:
    """(kind, number, offset) of what a text mentions, closes and calls its duplicate; of each number the lowest offset."""
    if not text or not re.fullmatch(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+", repo or ""):
        return []
    local = without_foreign(text, repo)
    quoted, found = without_quotes(local), {}
    kinds = {"mentions": "", "closes": rf"\b{CLOSES}\s+(?:this\s+)?", "duplicates": rf"\b{DUPLICATES}\s+(?:of|by|for)?\s*"}
    for kind, lead in kinds.items():
        for form in _forms(repo, lead)[1 if kind == "duplicates" else 0 :]:
            for m in form.finditer(local):
                at = m.start(1) - (local[m.start(1) - 1] == "#")
                if quoted[at : m.end()] != local[at : m.end()] or _is_noise(local, at, repo):
                    continue
                key = kind, int(m.group(1))
                found[key] = min(at, found.get(key, at))
    return sorted((kind, number, at) for (kind, number), at in found.items())


def paths_of(text: str | None, repo: str) -> list[tuple[str, bool]]:
    """(path, in backticks) of Python frames, path:line:column, links to files of this repository, and code with a file name."""
    found: dict[str, bool] = {}

    def note(path: str, ticked: bool = False) -> None:
        path = path.replace("\\\\", "/").strip().rstrip(".,;:!?)>]}").split("#", 1)[0]
        if path and "://" not in path and not path.startswith(("http", "mailto:")) and ("/" in path or "." in path):
            found[path] = found.get(path, False) or ticked

    for m in FRAME.finditer(text or ""):
        note(m.group(1))
    for m in re.finditer(r"(?<![\w./-])([\w./-]+):\d+:\d+", without_foreign(text or "", repo)):
        if "/" in m.group(1) and "//" not in m.group(1):
            note(m.group(1))
    for m in re.finditer(rf"(?i){FORGE}{re.escape(repo)}/blob/[^/\s)]+/([^\s)`]+)", text or ""):
        note(m.group(1))
    for m in re.finditer(r"`([^`\n]+)`", text or ""):
        if "/" in m.group(1) and "." in m.group(1) and "://" not in m.group(1):
            note(m.group(1), True)
    return sorted(found.items())


def signatures_of(text: str | None) -> list[tuple[str, str, str | None]]:
    """(exception, its line with addresses and numbers masked, function of the frame before) of fenced blocks; the first of each."""
    found: dict[tuple[str, str], str | None] = {}
    for block in re.findall("```.*?```", text or "", re.DOTALL):
        function = None
        for line in block.splitlines():
            if frame := FRAME.match(line.strip()):
                function = frame.group(2)
            if error := ERROR.match(line):
                masked = re.sub("0[xX][0-9a-fA-F]+", "<hex>", error.group())
                masked = re.sub(r"(?<![A-Za-z0-9_])\d+(?![A-Za-z0-9_])", "<n>", masked).strip()
                found.setdefault((error.group(1), masked), function)
    return [(name, line, function) for (name, line), function in sorted(found.items())]


def task_refs_of(text: str | None) -> list[int]:
    """Numbers that check boxes of a task list name first."""
    return sorted({int(m.group(1)) for m in re.finditer(rf"(?m)^\s*[-*+]\s+\[[ xX]\]\s[^\n#]*#([0-9]{{1,{DIGITS}}})\b", text or "")})


def claim_of(body: str | None, words: tuple[str, ...] = CLAIM_WORDS) -> tuple[str, str | None, list[int]] | None:
    """(release or claim, token, issues named) of a comment. A release begins the comment, and is looked for first."""
    if not body:
        return None
    if body.startswith(RELEASE):
        token = TOKEN.search(body)
        return "release", token and token.group(1), []
    fenced = False
    for line in body.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            fenced = not fenced
            continue
        if fenced or bare.startswith(">") or not any(w.lower() in line.lower() for w in words):
            continue
        token, listed = TOKEN.search(line), re.search(r"(?:^|\s)issues=(\S+)", line)
        pieces = [p.strip().removeprefix("#") for p in listed.group(1).split(",") if "/" not in p] if listed else []
        named = {int(p) for p in pieces if re.fullmatch(f"[0-9]{{1,{CLAIM_DIGITS}}}", p)}
        for m in re.finditer(rf"#([0-9]{{1,{CLAIM_DIGITS}}})(?!\w)", line):
            if not re.search(r"/[\w.-]+$", line[: m.start()]):
                named.add(int(m.group(1)))
        return "claim", token and token.group(1), sorted(named)
    return None


def _column(returns: str, f, *cols: Column) -> Column:
    """f over the rows, in Arrow batches, once for equal rows of a batch; the names of a struct's fields come from its type."""
    kind = to_arrow_type(DataType.fromDDL(returns))

    @F.arrow_udf(returns)
    def run(*columns: pa.Array) -> pa.Array:
        places: dict[tuple, int] = {}
        at = [places.setdefault(row, len(places)) for row in zip(*[c.to_pylist() for c in columns], strict=True)]
        return pa.array([f(*row) for row in places], kind).take(pa.array(at, pa.int64()))

    return run(*cols)


def references(text: Column, repo: Column) -> Column:
    return _column("array<struct<kind:string,number:long,at:int>>", lambda t, r: [{"kind": k, "number": n, "at": at} for k, n, at in references_of(t, r)], text, repo)


def paths(text: Column, repo: Column) -> Column:
    return _column("array<struct<path:string,ticked:boolean>>", lambda t, r: [{"path": p, "ticked": x} for p, x in paths_of(t, r)], text, repo)


def signatures(text: Column) -> Column:
    return _column("array<struct<exception:string,line:string,function:string>>", lambda t: [{"exception": e, "line": x, "function": f} for e, x, f in signatures_of(t)], text)


def task_refs(text: Column) -> Column:
    return _column("array<long>", task_refs_of, text)


def claims(body: Column) -> Column:
    def one(b):
        found = claim_of(b)
        return None if found is None else {"kind": found[0], "token": found[1], "named": found[2]}

    @F.pandas_udf("array<struct<kind:string,token:string,named:array<long>>>")
    def run(bodies: pd.Series) -> pd.Series:
        return pd.Series([[x] if (x := one(b)) else [] for b in bodies], dtype=object)

    return run(body)


def is_bot(login: Column, kind: Column, listed: list[str]) -> Column:
    """A bot by its name, by the kind of its account, or by the list."""
    return F.coalesce(login.endswith("[bot]") | (kind == "Bot") | login.isin(listed), F.lit(False))


def glob_matches(path: Column, pattern: str) -> Column:
    """fnmatch: * and ? cross slashes, [] is a set."""
    import fnmatch

    return path.rlike("^" + fnmatch.translate(pattern).replace("(?s:", "(?s:").replace(r"\z", "$").replace(r"\Z", "$"))


def like_paths(path: Column, wanted: str) -> Column:
    """Whether a path could be meant: the same but for case, or the same file name."""
    last = wanted.rsplit("/", 1)[-1].lower()
    return (F.lower(path) == wanted.lower()) | (F.lower(F.element_at(F.split(path, "/"), -1)) == last)


def snippet(text: str, words: list[str], size: int = 12, left: str = "«", right: str = "»") -> str:
    """`size` words of the text around the densest place of the query's words, which are marked; for a page's rows only."""
    tokens, wanted = list(re.finditer(r"\w+", text)), {w.lower() for w in words}
    hits = [i for i, m in enumerate(tokens) if m.group().lower() in wanted]
    start = max(hits, key=lambda i: (bisect_right(hits, i + size - 1) - bisect_right(hits, i - 1), -i), default=0)
    start = max(0, min(start, len(tokens) - size))
    part = tokens[start : start + size]
    if not part:
        return ""
    out, at = [], part[0].start()
    for m in part:
        out += [text[at : m.start()], f"{left}{m.group()}{right}" if m.group().lower() in wanted else m.group()]
        at = m.end()
    return ("…" if start else "") + "".join(out) + ("…" if start + size < len(tokens) else "")
