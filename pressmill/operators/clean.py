"""Cleaning a tree before its main text is looked for: rules in a fixed order, on the tree in place."""

from __future__ import annotations

import re

from pressmill.operators.dom import Node, parse, trim

#: Names of boxes around articles.  Plain ones match anywhere in an id, class or name; anchored ones as written.
_BOXES = sorted("""
ajoutVideo articleheadings author-dropdown breadcrumbs byline cnnStryHghLght cnn_html_slideshow cnn_strycaptiontxt cnn_strylftcntnt cnn_stryspcvbx combx comment
communitypromo contact contentTools2 date foot inline-share-tools js_replies konafilter legende links mediaarticlerelated menucontainer navbar pagetools
popularquestions popup post-attributes retweet runaroundLeft shoutbox socialnetworking socialtools sponsor storytopbar-bucket subscribe tags the_answers
timestamp tools utility-bar vcard welcome_form wp-caption-text
""".split(), key=str.lower)  # fmt: skip
_ANCHORED = ("^fn$", "^inset$", "^print$", "^side$", "meta$")
BOX = re.compile("|".join([*map(re.escape, _BOXES), *_ANCHORED]), re.IGNORECASE)
#: Each is looked for in ids and then in classes.  The third is one character not of the set, and 'more'.
WIDGETS = [re.compile(p, re.IGNORECASE) for p in ("^caption$", " google ", "^[^entry-]more.*$", "[^-]facebook", "facebook-broadcasting", "[^-]twitter")]
_OWN_BLOCKS = ("a", "blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul")


def _holds_article(n: Node) -> bool:
    return any(d is not n and (d.tag == "article" or d.attrs.get("id") == "article" or d.attrs.get("itemprop") == "articleBody") for d in n.walk())


def _drop(root: Node, attr: str, pattern: re.Pattern, guard: bool) -> None:
    for n in [d for d in root.walk() if attr in d.attrs and pattern.search(d.attrs[attr])]:
        if n.parent is not None and not (guard and _holds_article(n)):
            n.remove()


def _loose_text(text: str, before: list[Node], after: list[Node], buffer: list[str], used: set[int]) -> None:
    """A run of loose text with the links next to it goes into the buffer."""
    if len(text) <= 1:
        return
    for side in (reversed(before), after):
        if side is after:
            buffer.append(text)
        for a in side:
            if a.tag != "a" or id(a) in used:
                break
            used.add(id(a))
            buffer.append(f" {a.outer_html()} ")


def _paragraph(buffer: list[str]) -> Node:
    body = parse(f"<p>{''.join(buffer)}</p>").children[-1]
    p = next((c for c in body.children if c.tag == "p"), None) or Node("p")
    p.parent, p.tail = None, ""
    return p


def _rebuild(n: Node) -> None:
    """Loose text among a block's children becomes paragraphs of its own."""
    kids, used, buffer, out = list(n.children), set(), [], []
    runs = [n.text, *(k.tail for k in kids)]  # runs[i] stands before kids[i]
    for i in range(len(kids) + 1):
        text = trim(runs[i])
        if text:
            # Only links right beside the run, with no text between, belong to it.
            before, after = [], []
            j = i - 1
            while j >= 0:
                before.insert(0, kids[j])
                if trim(runs[j]):
                    break
                j -= 1
            j = i
            while j < len(kids):
                after.append(kids[j])
                if trim(runs[j + 1]):
                    break
                j += 1
            _loose_text(text, before, after, buffer, used)
        if i < len(kids):
            k = kids[i]
            if k.tag == "p" and buffer:
                out.append(_paragraph(buffer))
                buffer = []
            out.append(k)
    if buffer:
        out.append(_paragraph(buffer))
    n.text, n.children = "", []
    for k in out:
        if id(k) not in used:
            k.tail = ""
            k.parent = None
            n.append(k)


def _paragraphs(root: Node, tag: str) -> None:
    for n in root.elements(tag):
        if not n.elements(*_OWN_BLOCKS):
            n.tag = "p"
        else:
            _rebuild(n)


def clean(root: Node) -> Node:
    """The tree without scripts, boxes and widgets, loose text in paragraphs."""
    for n in root.elements("body")[:1]:
        n.attrs.pop("class", None)
    for n in root.elements("article"):
        for a in ("id", "name", "class"):
            n.attrs.pop(a, None)
    for n in root.elements("em"):
        if not n.elements("img"):
            n.unwrap()
    for n in root.elements("span"):
        if {"dropcap", "drop_cap"} & set(n.attrs.get("class", "").split()):
            n.unwrap()
    for n in list(root.walk()):
        if n.tag in ("script", "style", "#comment"):
            n.remove()
    for a in ("id", "class", "name"):
        _drop(root, a, BOX, True)
    for w in WIDGETS:
        for a in ("id", "class"):
            _drop(root, a, w, False)
    for p in root.elements("p"):
        for n in p.elements("span"):
            n.unwrap()
    for tag in ("div", "span", "section"):
        _paragraphs(root, tag)
    return root
