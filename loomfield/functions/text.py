"""Text expressions: word splitting, paths, links, file classes. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders, endings and names of tests.
TEST_FOLDERS = ("test", "tests", "__tests__", "spec", "specs", "__mocks__", "mock", "mocks", "fixture", "fixtures", "stories", "e2e")
TEST_PATH = rf"(^|/)({'|'.join(TEST_FOLDERS)})/|[._-](test|spec|stories|mock)s?\.[a-z]+$|(^|/)test_[^/]+$|/docs?/schema/"
#: Files and folders whose lines nobody wrote.
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "uv.lock", "poetry.lock", "Gemfile.lock", "Cargo.lock", "composer.lock", "go.sum",
)
BUILT_SUFFIXES = (".min.js", ".min.css", ".map")
GENERATED_FOLDERS = ("dist", "build", "vendor", "third_party", "node_modules", "out", "target", ".venv")
#: Fixed pattern: names, mails and logins of bots and of programs that write along.
BOT = r"(?i)\[bot\]|^(dependabot|renovate|github-actions)|noreply@anthropic\.com|^claude$|copilot|cursor ?agent|^codex$|openai|^github-|-bot$|^bot-|^noreply@github\.com$"
#: What looks like a ticket's prefix and is none.
NOT_TICKETS = (
    "UTF", "ISO", "SHA", "HTTP", "HTTPS", "TLS", "SSL", "RFC", "ES", "MD", "MP", "PDF", "CSV", "JSON", "API", "UTC", "GMT", "ASCII", "ARM", "X",
    "IPV", "IPV6", "AES", "RSA", "SHA256", "OAUTH", "CVE", "COVID", "H", "ISO8601", "PEP", "CPU", "GPU", "RAM", "SSH", "DNS", "TCP", "UDP", "XML",
    "HTML", "CSS",
)
#: Mail hosts that anybody can have an address at, hosts that tools fill in, and their endings.
PUBLIC_MAIL = (
    "gmail.com", "googlemail.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "yahoo.com", "icloud.com", "me.com", "mac.com", "proton.me",
    "protonmail.com", "aol.com", "gmx.com", "gmx.de", "hey.com", "fastmail.com", "pm.me", "yandex.ru", "mail.com", "qq.com", "163.com",
)
PLACEHOLDER_HOSTS = ("example.com", "example.org", "example.net", "localhost", "none", "(none)", "test.com", "email.com", "domain.com")
PLACEHOLDER_ENDS = (".local", ".localdomain", ".invalid", ".example")
NOREPLY_HOST = "users.noreply.github.com"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _identifiers(text: Column, whole: str) -> Column:
    parts = F.transform(
        F.regexp_extract_all(text, F.lit(f"({whole})"), F.lit(1)),
        lambda w: F.regexp_extract_all(w, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1)),
    )
    return F.transform(F.flatten(parts), F.lower)


def code_words(text: Column) -> Column:
    """Parts of identifiers that start with a letter, of two characters or more: fetchUserID_list gives fetch, user, id, list."""
    return F.filter(_identifiers(text, "[A-Za-z][A-Za-z0-9]*"), lambda w: F.char_length(w) > 1)


def code_tokens(text: Column) -> Column:
    """All parts of identifiers, single letters and numbers too: k3s_v2 gives k, 3, s, v, 2."""
    return _identifiers(text, "[A-Za-z0-9]+")


def stems(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct six-character prefixes of the words outside a stop list."""
    kept = F.filter(words(text), lambda w: ~w.isin(*stop)) if stop else words(text)
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 6)))


def repo_token(root: Column) -> Column:
    """A word of letters for a root: twelve digits of its SHA-1 written as a to p."""
    return F.concat(F.lit("zzrepo"), F.translate(F.substring(F.sha1(root), 1, 12), "0123456789abcdef", "abcdefghijklmnop"))


def area_of(path: Column, levels: int = 2) -> Column:
    """The first folders of a path, `.` for a file at the top."""
    folders = F.split(path, "/")
    depth = F.least(F.size(folders) - 1, F.lit(levels))
    return F.when(depth > 0, F.array_join(F.slice(folders, 1, depth), "/")).otherwise(F.lit("."))


def ancestors(path: Column) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(path, "/")
    deep = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.when(F.size(parts) > 1, F.transform(deep, lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, path without its closing slash; no query, fragment, entities or trailing punctuation."""
    bare = F.regexp_replace(F.regexp_replace(F.rtrim(url), r"[.,;:!?]+$", ""), r"(?:&(?:gt|lt|quot|amp|#\d+);?)+$", "")
    bare = F.regexp_replace(bare, r"[.,;:!?]+$", "")
    found = lambda k: F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", k)
    return F.concat(F.lower(found(1)), F.lit("://"), F.lower(found(2)), F.regexp_replace(found(3), "/+$", ""))


def norm_remote(remote: Column) -> Column:
    """host/org/name of a git remote in either form."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(remote), r"^(?:[a-z+]+://)?(?:[^@/]+@)?", ""), r"(\.git)?/*$", "")
    return F.lower(F.regexp_replace(bare, r"^([^/:]+):", "$1/"))


def xml_text(html: Column) -> Column:
    """Text of markup: scripts and styles go, block ends become line ends, tags go, five entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)</(p|div|li|h[1-6]|tr|title)>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def clean_turn(text: Column, blocks: tuple[str, ...] = ("system-reminder", "command-name", "command-message", "command-args", "local-command-stdout")) -> Column:
    """A turn without the XML blocks that tools put into it."""
    names = "|".join(blocks)
    return F.trim(F.regexp_replace(text, rf"(?s)<({names})>.*?</\1>", ""))


def snippet(text: Column, terms: list[str], width: int = 220) -> Column:
    """A window of the flattened text that starts up to 60 characters before the first term, on a word, with ellipses."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    places = [F.nullif(F.instr(F.lower(flat), t.lower()), F.lit(0)) for t in terms] or [F.lit(None)]
    place = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)) - 1
    start = F.greatest(place - 60, F.lit(0))
    blank = F.when(start > 0, F.position(F.lit(" "), flat, start + 1)).otherwise(0)
    start = F.when((start > 0) & (blank > 0) & (blank - 1 < place), blank).otherwise(start)
    body = F.substring(flat, start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < F.char_length(flat), "…").otherwise(""))


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? don't."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return f"^{out}$"


def is_bot(name: Column) -> Column:
    return name.rlike(BOT)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_deployed(path: Column) -> Column:
    """A path whose lines count as deployed: no lock or built file, and in no generated folder."""
    parts = F.split(path, "/")
    built = F.lit(False)
    for suffix in BUILT_SUFFIXES:
        built = built | path.endswith(suffix)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return ~(built | F.element_at(parts, -1).isin(*LOCK_FILES) | F.arrays_overlap(folders, F.array(*[F.lit(f) for f in GENERATED_FOLDERS])))


def written_source(text: Column, mean: int = 120, long: int = 500, share: float = 0.01) -> Column:
    """Whether a big file looks written by hand: short lines on average and hardly any very long one."""
    lines = F.split(text, "\n", -1)
    return (F.octet_length(text) <= mean * F.size(lines)) & (F.size(F.filter(lines, lambda x: F.octet_length(x) > long)) <= share * F.size(lines))


def mail_class(mail: Column) -> Column:
    """placeholder, noreply, personal or work; an address without a host is a placeholder."""
    host = F.when(mail.contains("@"), F.lower(F.substring_index(mail, "@", -1))).otherwise("")
    filled = host.isin("", *PLACEHOLDER_HOSTS)
    for end in PLACEHOLDER_ENDS:
        filled = filled | host.endswith(end)
    return F.when(filled, "placeholder").when(host == NOREPLY_HOST, "noreply").when(host.isin(*PUBLIC_MAIL), "personal").otherwise("work")


def fold(name: Column) -> Column:
    """Lower case without common Latin accents, digits and punctuation; one space between words."""
    marks = "áàâäãåāçćčéèêëēíìîïīñńóòôöõøōśšúùûüūýÿžźż"
    plain = "aaaaaaaccceeeeeiiiiinnooooooossuuuuuyyzzz"
    return F.trim(F.regexp_replace(F.translate(F.lower(name), marks, plain), "[^a-z]+", " "))


def name_spellings(name: Column) -> Column:
    """Handles that a name may have: first, last, joined, dotted, initial and last, first and initial."""
    parts = F.split(fold(name), " ")
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    found = F.array(first, last, F.concat(first, last), F.concat_ws(".", first, last), F.concat(F.substring(first, 1, 1), last), F.concat(first, F.substring(last, 1, 1)))
    return F.array_distinct(F.filter(found, lambda s: F.char_length(s) > 2))


def size_class(column: Column, edges: tuple[int, ...]) -> Column:
    """Index of the first upper edge that a number doesn't exceed; len(edges) beyond all."""
    out = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        out = F.when(column <= edges[k], k).otherwise(out)
    return out


def links(text: Column) -> Column:
    """Every mention of a pull request, ticket or branch as (kind, key), in place of which kind it has."""
    url = r"https?://(?:www\.)?github\.com/([\w.-]+/[\w.-]+)/pull/(\d+)"
    plain = F.regexp_replace(text, url, " ")
    urls = F.transform(F.regexp_extract_all(text, F.lit(url), F.lit(0)), lambda u: F.regexp_replace(u, url, "$1#$2"))
    refs = F.regexp_extract_all(plain, F.lit(r"(?<![\w/.@-])([\w.-]+/[\w.-]+#\d+)\b"), F.lit(1))
    tickets = F.regexp_extract_all(text, F.lit(r"(?<![\w-])([A-Z][A-Z0-9]{1,9}-\d{1,6})\b"), F.lit(1))
    tickets = F.filter(tickets, lambda t: ~F.substring_index(t, "-", 1).isin(*NOT_TICKETS))
    branches = F.regexp_extract_all(text, F.lit(r"\b(?:checkout -b|switch -c|switch -C|checkout -B|push -u origin|push origin) ([\w./-]+)"), F.lit(1))
    branches = F.filter(F.transform(branches, lambda b: F.regexp_replace(b, r"[.,;:!?]+$", "")), lambda b: b != "")
    of = lambda kind, found: F.transform(found, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    return F.concat(of("pr", urls), of("pr", refs), of("ticket", tickets), of("branch", branches))
