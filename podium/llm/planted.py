"""Labelled findings for secret scans: secrets and look-alikes of known kind, planted in the corpus' own texts.

No table has reviewed findings, so they are made: a bounded sample of texts (about `limit`, by hash) lends the
surroundings and the paths; into each goes a secret or a look-alike drawn by a generator that the text seeds.
What was planted is the label, whatever the features say of it: key words stand before placeholders, too, and
keys stand without them.
"""

from __future__ import annotations

import random
import string
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEX, _B64 = "0123456789abcdef", string.ascii_letters + string.digits + "+/"
_URL, _UPPER = string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits
KEYS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "db_password", "API_TOKEN", "SECRET_KEY"]
ANNOUNCED = ['{k} = "{v}"', "{k}: {v}", "{k}={v}", "export {k}={v}", '"{k}": "{v}"', "{k}: '{v}'", "--{k}={v}", "the {k} is {k}={v},"]
#: What keeps the place of a secret, and what a key word may have behind it in code or prose.
HOLDERS = ["changeme", "changeme-please-now", "your_token_goes_here", "insert-your-key-here", "example-secret-value-1", "replace_with_your_key", "not-a-real-secret", "test-password-123", "dummy_value_000", "placeholder-2024", "required", "optional", "undefined", "hunter-example", "<your-key>", "${DB_PASSWORD}", "os.environ.get", "getPassword()", "config.secret_key", "process.env.API_TOKEN"]


def _of(r: random.Random, letters: str, lo: int, hi: int | None = None) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(lo, hi or lo)))


def _password(r: random.Random, words: list[str]) -> str:
    """Letters, digits and signs; or a word or two with digits or signs in them."""
    if r.random() < 0.6 or not words:
        v = _of(r, string.ascii_letters + string.digits + "!#$%&*+-.?@^_", 8, 18)
        return v if any(c.isdigit() for c in v) else v + str(r.randint(10, 99))
    w = [x.translate(str.maketrans("aeiost", "4310$7")) if r.random() < 0.5 else x.capitalize() for x in r.sample(words, min(2, len(words)))]
    return r.choice(["", "-", "_", "."]).join(w)[:16] + str(r.randint(2, 9999)) + r.choice(["", "!", "#", "$"])


def _announced(r: random.Random, value: str) -> tuple[str, str, str]:
    before, after = r.choice(ANNOUNCED).replace("{k}", r.choice(KEYS)).split("{v}")
    return before, value, after


def _pem(r: random.Random, name: str, lo: int, hi: int) -> str:
    """A block of base64 lines between a BEGIN and an END line; line feeds may be written as \\n."""
    body = _of(r, _B64, lo, hi) + r.choice(["", "=", "=="])
    return r.choice(["\n", "\n", "\\n"]).join([f"-----BEGIN {name}-----", *(body[i : i + 64] for i in range(0, len(body), 64)), f"-----END {name}-----"])


def _integrity(r: random.Random) -> str:
    name, size, end = r.choice([("sha256", 43, "="), ("sha384", 64, ""), ("sha512", 86, "==")])
    return f"{name}-{_of(r, _B64, size)}{end}"


def _plain(words: list[str]) -> list[str]:
    return words or ["plain", "words"]


_ALNUM = string.ascii_letters + string.digits
#: Kinds of secrets and of look-alikes: (before, value, after) from a generator and words of the text; a kind named more often is drawn more often.
SECRETS = {
    "aws_id": lambda r, w: ("key ", "AKIA" + _of(r, _UPPER, 16), " in"),
    "github_token": lambda r, w: (r.choice(["", "token ", "clone with "]), r.choice(["ghp_", "gho_", "ghs_"]) + _of(r, _ALNUM, 36), ""),
    "github_pat": lambda r, w: (r.choice(["", "use ", "pat "]), "github_pat_" + _of(r, _ALNUM, 22) + "_" + _of(r, _ALNUM, 59), ""),
    "stripe": lambda r, w: ("use ", "sk_live_" + _of(r, _ALNUM, 24), ""),
    "sk": lambda r, w: (r.choice(["", "key ", "with "]), r.choice(["sk-", "sk-proj-", "rk-"]) + _of(r, r.choice([_ALNUM, _URL]), 32, 64), r.choice(["", " here"])),
    "slack": lambda r, w: ("", "xoxb-" + _of(r, string.digits, 11) + "-" + _of(r, _ALNUM, 24), ""),
    "jwt": lambda r, w: (r.choice(["", "Bearer ", "jwt ", "cookie: session="]), "eyJ" + _of(r, _URL, 17, 40) + ".eyJ" + _of(r, _URL, 30, 120) + "." + _of(r, _URL, 43, 86), ""),
    "bearer": lambda r, w: ("Authorization: Bearer ", _of(r, _URL, 24, 60), ""),
    "url_password": lambda r, w: (f"{r.choice(['postgres', 'mysql', 'amqp', 'redis', 'https'])}://{r.choice(['admin', 'root', 'app', 'svc'])}:", _of(r, _ALNUM, 12, 20), "@db.internal:5432/app"),
    "private_key": lambda r, w: (r.choice(["", "key: ", 'private_key: "']), _pem(r, r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY", 180, 1700), ""),
    "hex": lambda r, w: _announced(r, _of(r, _HEX, r.choice([16, 24, 32, 40, 40, 48, 64]))),
    "base64": lambda r, w: _announced(r, _of(r, _B64, 24, 44)),
    "base64_url": lambda r, w: _announced(r, _of(r, _URL, 20, 43)),
    "alphanumeric": lambda r, w: _announced(r, _of(r, _ALNUM, 16, 32)),
    "password": lambda r, w: _announced(r, _password(r, w)),
}
LOOK_ALIKES = {
    "holder": lambda r, w: _announced(r, r.choice(HOLDERS)),
    "filler": lambda r, w: _announced(r, r.choice([lambda: r.choice("xX*0.#") * r.randint(8, 24), lambda: "123456789012345678901234"[: r.randint(8, 24)]])()),
    "announced_words": lambda r, w: _announced(r, r.choice([lambda: r.choice(["-", "_", ""]).join(r.sample(_plain(w), min(3, len(_plain(w))))), lambda: r.choice(_plain(w))])()),
    "commit": lambda r, w: (r.choice(["commit ", "sha1: ", "revision ", "blob ", "merge "]), _of(r, _HEX, 40), ""),
    "checksum": lambda r, w: (r.choice(["sha256:", "md5 = ", "checksum: ", "etag: ", "digest="]), _of(r, r.choice([_HEX, _HEX, _B64]), r.choice([32, 40, 64])), ""),
    "integrity": lambda r, w: (r.choice(['integrity="', "integrity: ", "integrity ", "", '"hash": "', "script-src '"]), _integrity(r), r.choice(["", '"', "'"])),
    "certificate": lambda r, w: (r.choice(["", "cert: ", "ca "]), _pem(r, r.choice(["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST"]), 180, 1700), ""),
    "uuid": lambda r, w: (r.choice(["id=", "request-id: ", "uuid ", "session "]), "-".join(_of(r, _HEX, n) for n in (8, 4, 4, 4, 12)), ""),
    "time": lambda r, w: ("on ", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}:22:{r.randint(10, 59)}.{r.randint(100, 999)}Z", ""),
    "version": lambda r, w: ("version ", f"{r.randint(0, 20)}.{r.randint(0, 99)}.{r.randint(0, 999)}-rc{r.randint(1, 9)}+build{r.randint(100, 9999)}", ""),
    "phone": lambda r, w: ("call ", f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}", ""),
    "card": lambda r, w: ("card ", "-".join(str(r.randint(1000, 9999)) for _ in range(4)), ""),
    "number": lambda r, w: ("order ", str(r.randint(10**12, 10**18)), ""),
    "mail": lambda r, w: ("mail ", f"{r.choice(_plain(w))}.{r.choice(_plain(w))}{r.randint(1, 99)}@{r.choice(_plain(w))}.example.com", ""),
    "link": lambda r, w: ("see ", f"https://www.{r.choice(_plain(w))}.org/{r.choice(_plain(w))}/{r.randint(1, 9999)}/{r.choice(_plain(w))}", ""),
    "file": lambda r, w: ("in ", f"/usr/{r.choice(_plain(w))}/{r.choice(_plain(w))}{r.randint(1, 99)}/{r.choice(_plain(w))}.py", ""),
    "camel": lambda r, w: ("", "".join(x.capitalize() for x in r.sample(_plain(w), min(4, len(_plain(w))))) + str(r.randint(1, 99)), "()"),
    "snake": lambda r, w: ("", "_".join(r.sample(_plain(w), min(4, len(_plain(w))))) + f"_{r.randint(1, 999)}", ""),
    "slug": lambda r, w: (r.choice(["", 'class="', "#"]), r.choice(["sk-", "task-", ""]) + "-".join(r.sample(_plain(w), min(4, len(_plain(w))))) + f"-{r.randint(1, 999)}", ""),
    "module": lambda r, w: (r.choice(["import ", "at "]), ".".join(["com", *r.sample(_plain(w), min(3, len(_plain(w)))), r.choice(_plain(w)).capitalize() + str(r.randint(1, 99))]), ""),
    "iban": lambda r, w: ("IBAN ", "DE" + _of(r, string.digits, 20), ""),
    "image": lambda r, w: ("data:image/png;base64,", "iVBORw0KGgo" + _of(r, _B64, 30, 50), ""),
    "address": lambda r, w: ("address ", "192.168." + f"{r.randint(0, 255)}.{r.randint(0, 255)}:{r.randint(1000, 65000)}", ""),
}
_OFTEN = {True: ["hex", "base64", "base64_url", "alphanumeric", "password", "password", "password"], False: ["holder", "holder", "filler", "announced_words", "announced_words", "announced_words"]}


def planted(r: random.Random, words: list[str], label: int) -> tuple[str, str, str, str]:
    """(kind, before, value, after) of a secret (label 1) or of a look-alike (0)."""
    kinds = SECRETS if label else LOOK_ALIKES
    kind = r.choice([*kinds, *_OFTEN[bool(label)]])
    return kind, *kinds[kind](r, words)


def findings(docs: DataFrame, find, limit: int) -> list[tuple[bytes, int, int, str | None, int, str]]:
    """About `limit` labelled findings (text, start, end, path, label, kind). find: the candidates of texts, as the scan finds them.

    docs has text and source. About as many texts as findings lend their surroundings; fewer texts lend more than once.
    """
    n = docs.count()
    drawn = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1 << 40)) / float(1 << 40)
    at = F.pmod(F.xxhash64("text", F.lit(24)), F.greatest(F.length("text") - 120, F.lit(1)).cast("long"))
    some = docs.where("text is not null").where(drawn < 1.2 * limit / max(n, 1)).select(F.substring("text", at.cast("int") + 1, F.lit(120)).alias("t"), "source", drawn.alias("d")).distinct()  # of many copies one
    places = sorted({(r["d"], r["t"], r["source"] or "") for r in some.collect()})[:limit]
    out = []
    for k in range(limit if places else 0):
        _, text, path = places[k % len(places)]
        r = random.Random(zlib.crc32(f"{k} {text}".encode("utf-8", "replace")))
        words = [w for w in text.lower().split() if w.isascii() and w.isalpha() and 3 <= len(w) <= 12]
        label = k // len(places) + k & 1
        kind, before, value, after = planted(r, words, label)
        left, right = text[:60], text[60:]
        whole = f"{left} {before}{value}{after} {right}"
        lo = len(f"{left} {before}".encode("utf-8", "surrogatepass"))
        hi = lo + len(value.encode())
        for _, own, s, e in find([whole]):
            both = min(e, hi) - max(s, lo)
            if 2 * both > max(hi - lo, 1) or both > 0 and not label:
                out.append((own, s, e, path or None, label, kind))
    return out
