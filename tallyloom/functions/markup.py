"""The standard library's parser with a short way for plain markup."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

#: Plain markup and the text behind it: an opening tag whose attributes stand in double quotes or are one word, with its closing tag,
#: others of that tag in a row (the cells of a table, say) and the text behind them if nothing but text is between, a closing tag, a doctype, a comment without dashes. The standard parser reads each of them the same way.
_SHAPES = r'([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n\f]+[a-zA-Z][-a-zA-Z0-9_:]*=(?:"[^"]*"|[-a-zA-Z0-9_.]+(?=[ \t\r\n\f>])))*)[ \t\r\n\f]*>([^<]*)(?:</\1>((?:<\1>[^<]*</\1>)*)([^<]*))?|/([a-zA-Z][a-zA-Z0-9]*)>([^<]*)|(?:![dD][oO][cC][tT][yY][pP][eE][^>]*>|!--[^->]*-->)([^<]*)'
PLAIN = re.compile(f"<(?:{_SHAPES})")
#: The same, and what else a "<" begins by its sign alone, so that each match begins where the last one ended.
_PIECES = re.compile(f"<(?:{_SHAPES}|())")
ATTRIBUTE = re.compile(r'([a-zA-Z][-a-zA-Z0-9_:]*)=(?:"([^"]*)"|([-a-zA-Z0-9_.]+))')
#: Where an element ends whose content is no markup.
RAW_ENDS = {tag: re.compile(rf"</\s*{tag}\s*>", re.I) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}


class Markup(HTMLParser):
    """Takes a whole page by one expression, a match for each piece of plain markup; from the first piece that isn't plain the
    standard parser reads the rest. The handlers are called as that alone would call them."""

    def feed(self, data: str) -> None:
        start_of, end_of, text_of = self.handle_starttag, self.handle_endtag, self.handle_data
        leaf_of, leaves_of = self.handle_leaf, self.handle_leaves
        at = data.find("<")
        if at > 0:
            text_of(unescape(data[:at]))
        rest = len(data) if at >= 0 else 0  # from here on the standard parser reads
        pieces = _PIECES.finditer(data, at) if at >= 0 else ()
        while pieces:
            later = ()
            for m in pieces:
                name, inside, held, more, behind, closed, text, other, odd = m.groups()
                if closed is not None:
                    end_of(closed.lower())
                elif name is not None:
                    tag, text = name.lower(), held
                    attrs = [(n.lower(), unescape(v) if "&" in v else v or word) for n, v, word in ATTRIBUTE.findall(inside)] if inside else []
                    if tag in RAW_ENDS:
                        if not (raw := RAW_ENDS[tag].search(data, m.start(3))):
                            rest = m.start()
                            break
                        start_of(tag, attrs)
                        if m.start(3) < raw.start():
                            text_of(data[m.start(3) : raw.start()])
                        end_of(tag)
                        at = data.find("<", raw.end())
                        if text := data[raw.end() : at if at >= 0 else len(data)]:
                            text_of(unescape(text))
                        later = _PIECES.finditer(data, at) if at >= 0 else ()
                        break
                    if behind is not None:
                        leaf_of(tag, attrs, unescape(held) if "&" in held else held)
                        if more:
                            texts = more[len(name) + 2 : -len(name) - 3].split(f"</{name}><{name}>")
                            leaves_of(tag, [unescape(x) for x in texts] if "&" in more else texts)
                        text = behind
                    else:
                        start_of(tag, attrs)
                elif odd is not None:
                    rest = m.start()
                    break
                else:
                    text = other
                if text:
                    text_of(unescape(text) if "&" in text else text)
            pieces = later
        if rest < len(data):
            super().feed(data[rest:])

    def handle_leaf(self, tag: str, attrs: list, text: str) -> None:
        """An element with nothing but text in it, or without any, and its closing tag."""
        self.handle_starttag(tag, attrs)
        if text:
            self.handle_data(text)
        self.handle_endtag(tag)

    def handle_leaves(self, tag: str, texts: list[str]) -> None:
        """Several of them in a row, without attributes."""
        for text in texts:
            self.handle_leaf(tag, [], text)
