"""JavaScript for replay: which names are read through the archive's own objects, and which URLs lead into it.

Three sets of rules: PROXIED (names go through objects that a script declares at its top), LOCATED (names are prefixed, and URLs
that begin a string become links), and none. Site rules, by prefix of the page's key, come before those of a set.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scanning import IT, Rule, scan, scan_text
from tidemark.functions.urls import surt

#: What the replay's client library is called by. Names that a script may read, the call that stands for
#: ``this``, the wrapped eval, the check before a new location, the sender of messages, and the prefix of replaced names.
NAMES = ("window", "self", "document", "location", "top", "parent", "frames", "opener")
THIS = "_____WB$wombat$check$this$function_____(this)"
EVAL = "WB_wombat_runEval2((_______eval_arg, isGlobal) => { var ge = eval; return isGlobal ? ge(_______eval_arg) : eval(_______eval_arg); }).eval(this, (function() { return arguments })(),"
LOCATION = "((self.__WB_check_loc && self.__WB_check_loc(location, arguments)) || {}).href = "
SENDER, WINDOW_SENDER, PREFIX = "__WB_pmw(self).", "__WB_pmw(self.window).", "WB_wombat_"
ASSIGN = "_____WB$wombat$assign$function_____"
#: What stands before and after a script whose names are declared, and the start of a worker.
OPENING = (
    f"\nvar {ASSIGN} = function(name) {{return (self._wb_wombat && self._wb_wombat.local_init && self._wb_wombat.local_init(name)) || self[name]; }};\n"
    "if (!self.__WB_pmw) { self.__WB_pmw = function(obj) { this.__WB_source = obj; return this; } }\n{\n"
    + "\n".join(f'let {name} = {ASSIGN}("{name}");' for name in NAMES) + "\nlet arguments;\n\n{"
)
CLOSING = "\n\n}}"
WORKER = "(function() {{ self.importScripts('{static}wombatWorkers.js'); new WBWombat({{'prefix': '{prefix}', 'prefixMod': '{prefix}wkrf_/', 'originalURL': '{url}'}}); }})();"
#: Modifiers of workers.
WORKERS = ("wkr_", "sw_")

#: Where ``this`` is the global object: returned, with one of NAMES read off it, assigned or passed, called with, or in a condition.
_GLOBAL_THIS = (
    Rule("this", THIS, r"\breturn\s+", r"\b\s*(?![.$])"),
    Rule("this", THIS, r"(?<![$.])\s*", rf"\b(?=\.(?:{'|'.join(NAMES)})\b)"),
    Rule("this", THIS, r"(?<=[=,])\s*", r"\b\s*(?![:.$])"),
    Rule("this", THIS, r"\}(?:\s*\))?\s*\(", r"\)"),
    Rule("this", THIS, r"(?<=[^|&][|&]{2})\s*", r"\b\s*(?![|&.$](?:[^|&]|$))"),
)
PROXIED = (
    Rule(r"eval\s*\(", EVAL, r"(?<!function)(?:\s|^)\b"),
    Rule("eval", "self.eval", r"(?<=[=,])\s*\b", r"\b\s*(?![(:.$])"),
    Rule(r"postMessage\b\(", SENDER + IT, r"(?<=\.)"),
    Rule(r"location\b\s*=\s*", IT + LOCATION, r"(?<![$.])\s*\b", r"(?!=)"),
    *_GLOBAL_THIS,
)
LOCATED = (
    Rule(r"\b(?:location|top)\b", PREFIX + IT, r"(?<![$'\"])", r"(?![$'\":])"),
    Rule("location", PREFIX + IT, r"(?<=[?])\s*(?:\w+[.])?", r"\s*(?=:)"),
    Rule(r"postMessage\b\(", WINDOW_SENDER + IT, r"(?<=\.)"),
    Rule(r"frameElement\b", PREFIX + IT, r"(?<=\.)"),
    Rule(r"(?:(?<=[\"';])https?:|(?<=[\"']))\\{0,4}/\\{0,4}/[A-Za-z0-9:_@%.\\-]+/", link=""),
)
#: An http(s) URL, its slashes escaped or not, and the rule that makes it a plain one.
ANY_URL = r"https?:\\?/\\?/[A-Za-z0-9:_@.-]+"
INSECURE = Rule("https", "http", after=r":\\?/\\?/[A-Za-z0-9:_@.-]+")


@dataclass(frozen=True)
class ScriptSet:
    """Rules of a kind, and what stands before and after a whole script."""

    rules: tuple[Rule, ...] = ()
    opening: str = ""
    closing: str = ""
    #: Scripts in attributes are left alone unless one of these occurs in them.
    names: tuple[str, ...] = ()


SETS = {"proxied": ScriptSet(PROXIED, OPENING, CLOSING, NAMES), "located": ScriptSet(LOCATED), "none": ScriptSet()}


def rewrite_script(text: str, link: Callable[[str, str], str], kind: str = "proxied", extra: Sequence[Rule] = ()) -> str:
    """One whole script."""
    own = SETS[kind]
    return own.opening + scan_text(text, (*extra, *own.rules), link) + own.closing


def rewrite_inline(text: str, link: Callable[[str, str], str], kind: str = "proxied", extra: Sequence[Rule] = ()) -> str:
    """A script in an attribute, with or without ``javascript:``, on one line; prefixed names are those of the window."""
    own = SETS[kind]
    if own.names:
        if not any(n in text for n in own.names):
            return text
        head = "javascript:" if text.startswith("javascript:") else ""
        return head + rewrite_script(text[len(head) :], link, kind, extra).replace("\n", "")
    return re.sub(rf"(?<!\.){PREFIX}", f"window.{PREFIX}", rewrite_script(text, link, kind, extra))


def rewrite_scripts(text: Column, url: Column, link: Callable[[Column, str], Column], kind: str = "proxied", sites: Mapping[str, Sequence[Rule]] | None = None) -> Column:
    """Whole scripts of a column; ``sites`` has further rules by prefix of the key of ``url``, of which the first that fits counts."""
    own = SETS[kind]
    out = scan(text, own.rules, link)
    key = surt(url)
    for prefix, rules in reversed((sites or {}).items()):
        out = F.when(F.coalesce(key.startswith(prefix), F.lit(False)), scan(text, (*rules, *own.rules), link)).otherwise(out)
    return F.concat(F.lit(own.opening), out, F.lit(own.closing)) if own.opening or own.closing else out


def archive_link(prefix: str, timestamp: Column, modifier: str = "") -> Callable[[Column, str], Column]:
    """Links of absolute URLs into the archive below ``prefix``, for ``rewrite_scripts``; those without a scheme get a prefix without."""
    loose = prefix.split(":", 1)[1] if prefix.startswith(("http://", "https://")) else prefix

    def link(url: Column, own: str) -> Column:
        moment = F.concat(F.coalesce(timestamp, F.lit("")), F.lit(own or modifier))
        behind = F.concat(moment, F.when(moment != "", "/").otherwise(""), url)
        return F.when(url.rlike("^(?:https?|ftp):"), F.concat(F.lit(prefix), behind)).otherwise(F.concat(F.lit(loose), behind))

    return link


def worker_script(text: Column, modifier: Column, prefix: str, static: str, url: Column) -> Column:
    """A script that a page loads as a worker (by its modifier), with the replay's start before it; other scripts as they are."""
    start = F.concat(*(F.lit(part.format(static=static, prefix=prefix, url="")) if n == 0 else F.concat(url, F.lit(part.format())) for n, part in enumerate(WORKER.split("{url}"))))
    return F.when(F.coalesce(modifier.isin(*WORKERS), F.lit(False)), F.concat(start, text)).otherwise(text)


def site_rules(config: Sequence[Mapping]) -> dict[str, tuple[Rule, ...]]:
    """Rules by key prefix from a rule file's entries: url_prefix (one or several) and rewrite.js_regexs of match, and replace ({0} is the match) or rewrite.

    An entry with a group other than 0 names a part of its match by brackets: the part is what is replaced.
    """
    out: dict[str, tuple[Rule, ...]] = {}
    for entry in config:
        rules = tuple(_site_rule(r) for r in (entry.get("rewrite") or {}).get("js_regexs") or () if "function" not in r)
        prefixes = entry.get("url_prefix") or ""
        for prefix in [prefixes] if isinstance(prefixes, str) else prefixes:
            if rules:
                out[prefix] = rules
    return out


def _site_rule(told: Mapping) -> Rule:
    before, core, after = "", told["match"], ""
    if told.get("group"):
        m = re.fullmatch(r"((?:\\.|[^\\()])*)\(((?:\\.|\[(?:\\.|[^\]])*\]|[^\\()])*)\)((?:\\.|[^\\()])*)", core)
        if not m:
            raise ValueError(f"the part to replace is not plain: {core}")
        before, core, after = m.groups()
    # capturing groups would be counted as the rules' own
    plain = re.sub(r"(?<!\\)((?:\\\\)*)\((?!\?)", r"\1(?:", core)
    return Rule(plain, before=before, after=after, link="") if told.get("rewrite") else Rule(plain, (told.get("replace") or "{0}").replace("{0}", IT), before, after)
