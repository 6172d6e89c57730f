"""Secret scan with structural confirmation.

Candidates are runs of base64, base64url or hex characters, of tokens with points, PEM blocks, and what begins like a key, be it in separated bytes or in lines with marks. Each is decoded and parsed before it is reported: DER
must nest with lengths that fill the whole, and have the fields of a key; OpenSSH keys must be made of length-prefixed
strings to the end; a signed token needs a JSON header with an algorithm, a JSON payload and a signature of the algorithm's length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import heapq
import json
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as wd

MIN_CHARS = 32
_CHARS = np.zeros(256, bool)
_CHARS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-."]] = True
#: Possessive, and ended by any five dashes: each block is gone through once.
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s\\:,]|-(?!----))*+)-----END \1-----")
#: A token within a longer run of its characters.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]++){2,4}")
_OIDS = {
    bytes.fromhex("2a864886f70d010101"): "rsa",
    bytes.fromhex("2a8648ce3d0201"): "ec",
    bytes.fromhex("2b6570"): "ed25519",
    bytes.fromhex("2b656e"): "x25519",
    bytes.fromhex("2b6571"): "ed448",
    bytes.fromhex("2a8648ce380401"): "dsa",
}
#: What begins like a key in base64: a DER sequence, or the name of OpenSSH's format. Each begins with characters of its own, which are searched for faster than alternatives.
_BASE64_HEADS = (re.compile(rb"M[A-I](?=(?:[A-Za-z0-9+/_-]|\\+/|%2[BbFf]){10})"), re.compile(rb"b3BlbnNzaC1rZXktdjEA"))
_PIECE = re.compile(rb"(?:[A-Za-z0-9+/_-]++|\\+/|%2[BbFf])++")
_PAD = re.compile(rb"(?:=|%3[Dd])*+")
#: Between two lines: the end of a line, which can be escaped, with quotes and marks around it. The second form also takes marks that are base64 characters.
_END = rb"(?:[ \t\"',;]{0,8}+\+?[ \t]{0,8}+(?:\\*+\r?\n|\\++r\\++n|\\++[nr]|(?:%0[Dd])?%0[Aa])){1,3}+"
_GAPS = (re.compile(_END + rb"[ \t>\"'#*|]{0,64}+"), re.compile(_END + rb"[ \t]{0,64}+(?:\+|-|//)[ \t]{0,64}+"))
_BETWEEN = rb"[\s:,;\"'\\]{0,64}+(?:0?x)?"
#: The same in hex, whose bytes can be apart.
_SIZE = _BETWEEN.join([rb"(?:[0-7][0-9A-Fa-f]|8(?:1|2", rb"[0-9A-Fa-f]{2})", rb"[0-9A-Fa-f]{2})"])
_HEX_HEADS = tuple(re.compile(_BETWEEN.join(x)) for x in ([b"30", _SIZE, b"(?:02", b"01", b"0[01]|30", _SIZE, b"06)"], [b"6[Ff]", b"70", b"65", b"6[Ee]", b"73", b"73", b"68"]))
_BYTE = re.compile(rb"(" + _BETWEEN + rb")([0-9A-Fa-f]{2})")
_BYTES = re.compile(rb"(?:" + _BETWEEN + rb"[0-9A-Fa-f]{2})++")
#: So many bytes of a key are looked at before its length is believed.
HEAD = 24
_MAGIC = b"openssh-key-v1\0"
_SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}


def der(data: bytes, lo: int = 0, hi: int | None = None, depth: int = 0) -> list | None:
    """Elements (tag, start, end, children) that fill data[lo:hi] exactly, or None."""
    hi = len(data) if hi is None else hi
    out = []
    while lo < hi:
        if depth > 12 or hi - lo < 2:
            return None
        tag, n, at = data[lo], data[lo + 1], lo + 2
        if n >= 128:
            k = n & 127
            if not 1 <= k <= 4 or at + k > hi:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 128 or data[at] == 0:  # not the shortest form
                return None
            at += k
        if at + n > hi:
            return None
        children = None
        if tag & 0x20:
            children = der(data, at, at + n, depth + 1)
            if children is None:
                return None
        out.append((tag, at, at + n, children))
        lo = at + n
    return out


def _der_kind(data: bytes) -> str | None:
    if len(data) < 16 or data[0] != 0x30:
        return None
    top = der(data)
    if not top or len(top) != 1:
        return None
    inner = top[0][3]
    tags = [x[0] for x in inner]
    number = lambda x: int.from_bytes(data[x[1] : x[2]], "big")
    if tags[:1] == [0x02] and len(tags) >= 9 and set(tags[:9]) == {0x02} and number(inner[0]) in (0, 1):
        n, e, p, q = (number(inner[i]) for i in (1, 2, 4, 5))
        return "rsa_private_key" if p * q == n and e > 1 else None
    if tags == [0x02] * 6 and number(inner[0]) == 0:
        return "dsa_private_key"
    if tags[:3] == [0x02, 0x30, 0x04] and number(inner[0]) in (0, 1):
        ids = inner[1][3]
        if ids and ids[0][0] == 0x06:
            return f"pkcs8_{_OIDS.get(data[ids[0][1] : ids[0][2]], 'other')}_private_key"
    if tags[:2] == [0x02, 0x04] and number(inner[0]) == 1 and all(t in (0xA0, 0xA1) for t in tags[2:]) and inner[1][2] - inner[1][1] >= 20:
        return "ec_private_key"
    if tags == [0x30, 0x04] and inner[0][3] and inner[0][3][0][0] == 0x06:
        return "encrypted_private_key"
    return None


def _strings(data: bytes, at: int, count: int) -> tuple[list[bytes], int] | None:
    out = []
    for _ in range(count):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + n > len(data):
            return None
        out.append(data[at : at + n])
        at += n
    return out, at


def _openssh_kind(data: bytes) -> str | None:
    if not data.startswith(_MAGIC):
        return None
    got = _strings(data, len(_MAGIC), 3)
    if not got or got[1] + 4 > len(data):
        return None
    keys = int.from_bytes(data[got[1] : got[1] + 4], "big")
    if not 1 <= keys <= 16:
        return None
    rest = _strings(data, got[1] + 4, keys + 1)
    if not rest or rest[1] != len(data):
        return None
    public = _strings(rest[0][0], 0, 1)
    return "openssh_private_key" if public and public[0][0].startswith((b"ssh-", b"ecdsa-", b"sk-")) else None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """Of the DER element at a place: where its content begins and ends, if that is given in up to two bytes."""
    if at + 4 > len(data):
        return None
    n, at = data[at + 1], at + 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 2:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 128 or data[at - k] == 0:  # not the shortest form
            return None
    return at, at + n


def _needed(data: bytes) -> int | None:
    """How many bytes a key has that begins like this, or, if more than there are, must be seen next; None if it is none."""
    if data[:1] == b"\x30":
        lo, hi = _length(data, 0) or (0, 0)
        first = data[lo : lo + 3]
        if first in (b"\x02\x01\x00", b"\x02\x01\x01"):
            at, fields = lo + 3, 1
            while hi - at >= 4:  # through the fields, of which no key has more than ten, so that little is read of what only begins like one
                if at + 4 > len(data):
                    return at + 4
                field = _length(data, at)
                fields += 1
                if fields > 10 or not field or data[at] not in (0x02, 0x04, 0x30, 0xA0, 0xA1) or field[1] > hi:
                    return None
                at = field[1]
            return hi
        return hi if first[:1] == b"\x30" and data.find(bytes.fromhex("2a864886f70d01"), lo, HEAD) > 0 else None
    if not _MAGIC.startswith(data[: len(_MAGIC)]):
        return None
    at, k = len(_MAGIC), 0
    while k < 5:  # three names, the number of keys (one), a public and the private part
        if at + 4 > len(data):
            return at + 4
        n = int.from_bytes(data[at : at + 4], "big")
        if n > 1 << 16:
            return None
        if k == 3 and n == 1 and at + 8 > len(data):
            return at + 8
        at += 4 + (n if k != 3 else 4 + int.from_bytes(data[at + 4 : at + 8], "big"))
        if at > 1 << 17:
            return None
        k += 1
    return at


def _base64_at(raw: bytes, at: int, stop: int, size: int, gap: re.Pattern) -> tuple[bytes, int, bool] | None:
    """The size bytes that stand from a place on in base64, where they end, and whether their line ends there too. The lines between the first and the last are of one length, and the last is no longer."""
    chars = left = -(-size * 4 // 3)
    parts: list[bytes] = []
    while True:
        m = _PIECE.match(raw, at, min(stop, at + 4 * left + 8))
        if not m:
            return None
        part = re.sub(rb"\\+/|%2[Ff]", b"/", re.sub(rb"%2[Bb]", b"+", m[0])) if b"\\" in m[0] or b"%" in m[0] else m[0]
        if len(parts) > 1 and not len(parts[-1]) == len(parts[1]) >= len(part) or len(parts) == 1 and len(part) >= max(left, len(parts[0]) + 1):
            return None
        parts.append(part)
        left -= len(part)
        if left <= 0:
            break
        end = gap.match(raw, m.end(), stop)
        if not end:
            return None
        at = end.end()
    text = b"".join(parts)[:chars].replace(b"-", b"+").replace(b"_", b"/")
    return base64.b64decode(text + b"=" * (-chars % 4)), _PAD.match(raw, m.end(), stop).end(), left == 0


def _hex_at(raw: bytes, at: int, stop: int, size: int) -> tuple[bytes, int, bool] | None:
    """The same in hex. What is between two bytes of a line is the same everywhere."""
    flat = raw[at : min(stop, at + 2 * size)]
    if len(flat) == 2 * size and re.fullmatch(rb"[0-9A-Fa-f]++", flat):
        return bytes.fromhex(flat.decode()), at + 2 * size, not re.match(rb"[0-9A-Fa-f]", raw[at + 2 * size : min(stop, at + 2 * size + 1)])
    run = _BYTES.match(raw, at, min(stop, at + 80 * size))
    pairs = list(islice(_BYTE.finditer(raw, at, run.end()), size)) if run else []
    if len(pairs) < size or len({m[1] for m in pairs[1:] if b"\n" not in m[1]}) > 1:
        return None
    end = pairs[-1].end()
    return bytes.fromhex(b"".join(m[2] for m in pairs).decode()), end, not re.match(rb"[0-9A-Fa-f]", raw[end : min(stop, end + 1)])


def _key_at(read: Callable[[int], tuple[bytes, int, bool] | None]) -> tuple[int, str] | None:
    """Where the key ends that read gives the first bytes of, and its kind."""
    size, needed = 0, HEAD
    while needed and needed > size:
        size = needed
        got = read(size)
        needed = got and _needed(got[0])
    if not needed or needed != size or not got[2]:
        return None
    kind = _der_kind(got[0]) or _openssh_kind(got[0])
    return (got[1], kind) if kind else None


def _headed(raw: bytes, off: np.ndarray, done: list[tuple[int, int]], min_chars: int) -> Iterator[tuple[int, int, str]]:
    """Keys, outside of what is done, that are found by how they begin and read as far as their lengths say: within a run after a name or before a word, in lines with marks around them, in separated bytes. off: where texts begin and end."""
    past = 0
    for m in heapq.merge(*(x.finditer(raw) for x in _BASE64_HEADS + _HEX_HEADS), key=lambda m: m.start()):
        s = m.start()
        k = bisect(done, (s, len(raw))) - 1
        if s < past or (k >= 0 and s < done[k][1]):
            continue
        stop = int(off[np.searchsorted(off, s, side="right")])
        reads = [partial(_hex_at, raw, s, stop)] if m.re in _HEX_HEADS else [partial(_base64_at, raw, s, stop, gap=gap) for gap in _GAPS]
        hit = next(filter(None, map(_key_at, reads)), None)
        if hit and hit[0] - s >= min_chars:
            past = hit[0]
            yield s, *hit


def _decoded(text: str) -> list[bytes]:
    """All byte strings that the text encodes."""
    out = []
    if len(text) % 2 == 0 and re.fullmatch("[0-9a-fA-F]+", text):
        out.append(bytes.fromhex(text))
    body = text.rstrip("=")
    if re.fullmatch("[A-Za-z0-9+/]+|[A-Za-z0-9_-]+", body) and len(body) % 4 != 1:
        try:
            out.append(base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True))
        except binascii.Error:
            pass
    return out


def _json(part: str):
    for raw in _decoded(part) if part else []:
        try:
            got = json.loads(raw)
        except (ValueError, RecursionError):
            continue
        if isinstance(got, dict):
            return got
    return None


def _token_kind(text: str) -> str | None:
    parts = text.split(".")
    if len(parts) not in (3, 5) or not parts[0] or not parts[-1]:
        return None
    head = _json(parts[0])
    alg = head.get("alg") if head else None
    if not isinstance(alg, str):
        return None
    if len(parts) == 5:
        return "encrypted_token" if isinstance(head.get("enc"), str) and all(_decoded(p) for p in parts[2:]) else None
    if _json(parts[1]) is None:
        return None
    body = [x for x in _decoded(parts[2]) if x]
    if alg in _SIGNATURES:
        return "signed_token" if any(len(x) == _SIGNATURES[alg] for x in body) else None
    return "signed_token" if alg[:2] in ("RS", "PS") and any(len(x) in (128, 256, 384, 512) for x in body) else None


def confirm(text: str, min_chars: int = MIN_CHARS) -> str | None:
    """The kind of secret that a candidate is, or None."""
    if "." in text:
        kind = _token_kind(text.strip("."))
        if kind:
            return kind
    for data in _decoded(text):
        kind = _der_kind(data) or _openssh_kind(data)
        if kind:
            return kind
        if re.fullmatch(rb"[\x20-\x7e\s]+", data):  # encoded twice
            pems = find(data)
            if pems:
                return pems[0][2]
            again = re.sub(r"\s|\\n", "", data.decode())
            for more in _decoded(again) if len(again) >= min_chars else []:
                kind = _der_kind(more) or _openssh_kind(more)
                if kind:
                    return kind
    return None


def find(data: bytes) -> list[tuple[int, int, str, bytes]]:
    """Secrets of one text's bytes: start and end byte, kind, and the candidate."""
    out = []
    for m in _PEM.finditer(data):
        # headers of old encrypted PEM end with an empty line
        body = re.sub(rb"(?m)^[A-Za-z0-9-]+:.*$", b"", m[2].replace(b"\\n", b"\n"))
        kind = confirm(re.sub(r"\s", "", body.decode("ascii", "replace")))
        if not kind and b"ENCRYPTED" in m[2]:
            kind = "encrypted_private_key"
        if kind:
            out.append((m.start(), m.end(), kind, m[0]))
    return out


def _wrapped(raw: bytes, runs: list[tuple[int, int]], k: int) -> int:
    """Number of the last run of those that continue run k on the next lines: all of one length, the last one of it or less; k if there are none."""
    size, j = runs[k][1] - runs[k][0], k
    while j + 1 < len(runs) and runs[j][1] - runs[j][0] == size and runs[j + 1][1] - runs[j + 1][0] <= size:
        gap = raw[runs[j][1] : min(runs[j + 1][0], runs[j][1] + 16)]
        if len(gap) != runs[j + 1][0] - runs[j][1] or gap.strip() or gap.count(b"\n") != 1:
            break
        j += 1
    return j


def _confirmed(text: str, min_chars: int) -> tuple[int, str, str] | None:
    """Where in a run of characters a secret begins, the secret, and its kind."""
    kind = confirm(text, min_chars)
    if kind:
        return 0, text, kind
    for m in re.finditer(r"[^=.]+={0,2}", text):  # a name and an equals sign, or sentence points, can touch the candidate
        if len(m[0]) >= min_chars and m[0] != text and (kind := confirm(m[0], min_chars)):
            return m.start(), m[0], kind
    m = _TOKEN.search(text)
    if m and m[0] != text and (kind := confirm(m[0], min_chars)):
        return m.start(), m[0], kind
    return None


def _scan(min_chars: int):
    def run(batches):
        for b in wd.slices(batches):
            data, off = wd.buffers(b.column(1))
            got = []
            if len(data):
                ok = _CHARS[data]
                inner = off[(off > 0) & (off < len(data))]
                first, last = ok.copy(), ok.copy()
                first[1:] &= ~ok[:-1]
                last[:-1] &= ~ok[1:]
                first[inner], last[inner - 1] = ok[inner], ok[inner - 1]
                start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
                raw = data.tobytes()
                at = raw.find(b"-----BEGIN ")
                pems, done = set(), []
                while at >= 0:
                    pems.add(int(np.searchsorted(off, at, side="right")) - 1)
                    at = raw.find(b"-----BEGIN ", at + 1)
                for k in sorted(pems):
                    for s, e, kind, text in find(raw[off[k] : off[k + 1]]):
                        got.append((k, s, e, kind, text))
                        done.append((int(off[k]) + s, int(off[k]) + e))
                # runs that are long enough, and the one after each, which can be its last line
                long = end - start >= min_chars
                near = np.flatnonzero(long | np.r_[False, long[:-1]])
                runs = list(zip(start[near].tolist(), end[near].tolist()))
                text_of = (np.searchsorted(off, start[near], side="right") - 1).tolist()
                i = 0
                while i < len(runs):
                    s, e = runs[i]
                    k, lo = text_of[i], int(off[text_of[i]])
                    past = bisect(done, (s, len(data))) - 1
                    if e - s < min_chars or (past >= 0 and s < done[past][1]):
                        i += 1
                        continue
                    j = _wrapped(raw, runs, i)
                    while text_of[j] != k:
                        j -= 1
                    for last in range(j, max(i, j - 2), -1):  # the last line can be full, and what follows a word
                        kind = confirm(re.sub(r"\s", "", raw[s : runs[last][1]].decode("ascii")), min_chars)
                        if kind:
                            got.append((k, s - lo, runs[last][1] - lo, kind, raw[s : runs[last][1]]))
                            j = last
                            break
                    else:  # else each line stands for itself
                        for s, e in runs[i : j + 1]:
                            hit = e - s >= min_chars and _confirmed(raw[s:e].decode("ascii"), min_chars)
                            if hit:
                                got.append((k, s - lo + hit[0], s - lo + hit[0] + len(hit[1]), hit[2], hit[1].encode()))
                    i = j + 1
                done = sorted((int(off[k]) + s, int(off[k]) + e) for k, s, e, *_ in got)
                for s, e, kind in _headed(raw, off, done, min_chars):
                    k = int(np.searchsorted(off, s, side="right")) - 1
                    got.append((k, s - int(off[k]), e - int(off[k]), kind, raw[s:e]))
            got.sort()
            rows = pa.array([g[0] for g in got], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.string()), pa.array([hashlib.sha256(g[4]).hexdigest() for g in got], pa.string())], ["doc_id", "start_byte", "end_byte", "kind", "fingerprint"])

    return run


def secrets(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, start_byte, end_byte, kind, fingerprint)`` of confirmed secrets; positions are in the UTF-8 text, fingerprint is the SHA-256 of the secret, which isn't shown itself.

    Candidates have min_chars characters or more. Lines of one length that follow each other are tried as one candidate first. Keys of up to 64 KB
    are also found by how they begin, and read as far as their lengths say: after a name or "0x" in the same run, in lines of any length with quotes or other marks around them, with escaped or percent-encoded ends of lines, and in hex with its bytes apart. Runs of the shape alone, like hashes and digests, aren't reported, nor are
    public keys. Null and empty texts have none, an empty table gives no rows, and very long texts are read whole, in linear time. Each row
    stands for itself: a null doc_id is reported as null, repeated rows repeat. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_scan(min_chars), "doc_id long, start_byte int, end_byte int, kind string, fingerprint string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Parsing nested encodings has no SQL form; tests plant keys and tokens.
SQL = None
