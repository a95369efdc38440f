"""WARC derivatives: a metadata and a plain-text conversion record for every response record, linked to it.

Input is a table of response records (record_id, target_uri, date, http_headers, payload, payload_digest).
Each is converted on its own; nothing is shuffled.
"""

import base64
import hashlib
import html
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches

CRLF = "\r\n"
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
TEXT_TYPE, FIELDS_TYPE = "text/plain; charset=utf-8", "application/warc-fields"
#: Elements of HTML whose content is no text, and those that end a line.
HIDDEN = {"script", "style", "template", "noscript", "title", "head", "svg", "iframe", "textarea", "select"}
RAW = {"script", "style", "title", "textarea"}
#: Elements that may stand in a head; any other ends one that is not closed.
IN_HEAD = {"base", "head", "html", "link", "meta", "noscript", "script", "style", "template", "title"}
LINES = {
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
CHARSET = re.compile(r"charset\s*=\s*[\"']?([-\w]+)", re.I)


def digest(data: bytes) -> str:
    """Labelled digest in the usual form: sha1, base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    """Record id that depends on the source record and the kind of derivative only, so a repeated run repeats it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"


def events(page: str):
    """("text", text), ("open", name, attributes, place after it) and ("close", name) of an HTML text, in order, in linear time."""
    at, n = 0, len(page)
    no_more = set()  # closing strings known not to follow any more
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        if page.startswith(("<!", "<?"), lt):
            close = "-->" if page.startswith("<!--", lt) else ">"
            end = -1 if close in no_more else page.find(close, lt + (4 if close == "-->" else 2))
            if end < 0:
                no_more.add(close)
                if close == ">":
                    yield "text", page[lt:]
                return  # an open comment hides the rest
            at = end + len(close)
            continue
        m = None if ">" in no_more else TAG.match(page, lt)
        if not m:
            if page.find(">", lt) < 0:
                no_more.add(">")
            yield "text", "<"
            at = lt + 1
            continue
        name = m[2].lower()
        at = m.end()
        if m[1]:
            yield "close", name
            continue
        yield "open", name, m[3], at
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            stop = end.start() if end else n
            yield "text", page[at:stop]
            at = stop


def closed_last(page: str, name: str, known: dict[str, int]) -> int:
    """Place of the last end tag of an element in the page, -1 without one; looked for once a page."""
    if name not in known:
        known[name] = max((m.start() for m in re.compile(f"</{name}", re.I | re.A).finditer(page)), default=-1)
    return known[name]


def read_page(page: str) -> tuple[str, list[tuple[str, str]]]:
    """Visible text (one line per block, white space collapsed) and the metadata fields of a page.

    A head without its end tag ends at the first element or text that may not be in it. Another hidden element ends with its
    parent at the latest, and hides nothing where the rest of the page does not close it at all (a script, style, title or text
    area reaches to the end then).
    """
    last: dict[str, int] = {}  # where the last end tag of an element stands
    outer: dict[str, int] = {}  # open elements outside of what is hidden, and inside
    inner: dict[str, int] = {}
    out: list[str] = []
    title: list[str] = []
    fields: list[tuple[str, str]] = []
    hidden: list[str] = []
    for kind, what, *rest in events(page):
        if kind == "text":
            if hidden == ["head"] and not what.isspace():
                hidden.clear()
            if not hidden:
                out.append(what)
            elif hidden[-1] == "title":
                title.append(what)
        elif kind == "open":
            found = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTR.findall(rest[0])} if rest[0] else {}
            if what == "html" and found.get("lang"):
                fields.append(("language", found["lang"]))
            elif what == "a" and found.get("href"):
                fields.append(("outlink", f"{found['href']} L a/@href"))
            elif what == "meta" and found.get("name") and found.get("content"):
                fields.append((f"meta-{found['name'].lower()}", found["content"]))
            if what == "body" or (hidden == ["head"] and what not in IN_HEAD):
                hidden.clear()
            if not rest[0].endswith("/"):
                now = inner if hidden else outer
                now[what] = now.get(what, 0) + 1
                if what in HIDDEN and (what in RAW or what == "head" or rest[1] <= closed_last(page, what, last)):
                    if not hidden:
                        inner.clear()
                    hidden.append(what)
            if what in LINES:
                out.append("\n")
        else:
            if what in hidden:
                while hidden.pop() != what:
                    pass
            elif hidden and inner.get(what):
                inner[what] -= 1
            elif outer.get(what):
                outer[what] -= 1
                hidden.clear()  # the parent of what is hidden ends
            if what in LINES:
                out.append("\n")
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    name = " ".join(html.unescape("".join(title)).split())
    return "\n".join(x for x in lines if x), ([("title", name)] if name else []) + fields


def body_text(payload, headers: str) -> str:
    """Payload as text, by the charset of its headers (UTF-8 if none or unknown)."""
    if payload is None:
        return ""
    if isinstance(payload, str):
        return payload
    m = CHARSET.search(headers or "")
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _clean(value: str) -> str:
    return " ".join(value.split())


def derive(responses: DataFrame, carry: tuple = ()) -> DataFrame:
    """Two rows per response: its metadata record and its conversion record.

    Columns: ``carry``, record_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, payload_digest (the source's), source_headers, headers, block. ``headers`` and ``block`` make
    up the record as written to a file. record_type is ``metadata`` or ``conversion``. Null payloads give an empty text and a
    metadata block without fields from it; a null record_id gives null refers_to and ids from the uri. Repeated
    responses are converted each. Header lines are kept whole.
    """
    columns = ["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"]
    kinds = dict(responses.dtypes)
    names = [*carry, *columns]
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + (", " if carry else "") + (
        "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length bigint, "
        "block_digest string, payload_digest string, source_headers string, headers string, block string")

    def make():
        def records(record_id, uri, date, source_headers, payload, payload_digest):
            text, fields = read_page(body_text(payload, source_headers))
            fields = [("source-digest", payload_digest)] * (payload_digest is not None) + fields
            about = "".join(f"{k}: {_clean(v)}{CRLF}" for k, v in fields)
            for kind, content_type, block in (("metadata", FIELDS_TYPE, about), ("conversion", TEXT_TYPE, text)):
                raw = block.encode("utf-8", "replace")
                own, block_digest = derived_id(record_id or uri or "", kind), digest(raw)
                head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {own}"]
                head += [f"{k}: {v}" for k, v in (
                    ("WARC-Refers-To", record_id), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri),
                    ("WARC-Date", date), ("WARC-Block-Digest", block_digest), ("Content-Type", content_type), ("Content-Length", len(raw))) if v is not None]
                yield kind, own, record_id, uri, date, content_type, len(raw), block_digest, payload_digest, source_headers, CRLF.join(head) + CRLF + CRLF, block

        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 64):  # so the text of few pages is held at a time
                    part = b.slice(lo, 64)
                    rows = list(zip(*(c.to_pylist() for c in part.columns)))
                    yield list(zip(*[(*r[:len(carry)], *rec) for r in rows for rec in records(*r[len(carry):])]))

        return run

    return map_batches(responses.select(*[F.col(f"`{n}`") for n in names]), make, ddl)


def responses_of(pages: DataFrame, date: str, id_col: str = "page_id") -> DataFrame:
    """Response records of a table of pages (id, url, html): headers, digest and an id that depends on id and url."""
    def make():
        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    part = b.slice(lo, 256)
                    rows = []
                    for key, url, page in zip(*(c.to_pylist() for c in part.columns)):
                        raw = (page or "").encode("utf-8", "replace")
                        headers = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(raw)}{CRLF}"
                        rows.append((key, f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {url}')}>", url, date, headers, page, digest(raw)))
                    yield list(zip(*rows))

        return run

    kind = dict(pages.dtypes)[id_col]
    ddl = f"`{id_col}` {kind}, record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string"
    return map_batches(pages.select(F.col(f"`{id_col}`"), "url", "html"), make, ddl)


def record_bytes(df: DataFrame):
    """Column with a whole record: headers, block and the two line ends after it."""
    return F.concat(F.encode(F.col("headers"), "UTF-8"), F.encode(F.col("block"), "UTF-8"), F.encode(F.lit(CRLF + CRLF), "UTF-8"))
