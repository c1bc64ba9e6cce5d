"""The labelled table of the HTML extractor: pages of varied templates, data-main naming what belongs to the main text.

Each template is filled with texts of other lengths in turn, since lengths differ between pages and names must not tell
them apart. {s} stands for a short sentence, {m} and {l} for longer ones, {w} for a few words without an end.
"""

from __future__ import annotations

_SENTENCES = (
    "The committee met on Tuesday to discuss the new plan for the harbour, and after three hours of debate it agreed to send the proposal back.",
    "Nobody could say where the boats had gone.",
    "Yes.",
    "In the long run the town will have to decide whether it wants more ships, fewer ships or none at all, said the mayor in an interview.",
    "It rained all night and the river rose by a metre before anyone noticed that the lower road was under water again.",
    "Prices fell.",
    "Most of the people who live there have done so for thirty years or more, which is why they know every stone of the old bridge.",
)
_PHRASES = ("Read more", "Contact us", "Boats and ships", "All rights reserved", "Older posts here", "The Daily Example", "World")


def _fill(page: str, turn: int) -> str:
    """The page with texts in place of its marks, which differ from turn to turn."""
    out, n = [], turn
    for i, part in enumerate(page.split("{")):
        if i:
            kind, part = part[0], part[2:]
            n += 1
            if kind == "w":
                out.append(_PHRASES[n % len(_PHRASES)])
            else:
                few = {"s": 1, "m": 2, "l": 5}[kind]
                out.append(" ".join(_SENTENCES[(n * 3 + k + turn) % len(_SENTENCES)] for k in range(few)))
        out.append(part)
    return "".join(out)


_TEMPLATES = (
    "<body><nav><ul><li><a href=a>{w}</a><li><a href=b>{w}</a></ul></nav><div class=ad>{s}</div><article data-main><h1>{w}</h1><p>{l}<p>{s}<p>{m}<p>{s}</article><footer>{w} {s}</footer>",
    "<body><header><h1>{w}</h1><p>{s}</header><main><div data-main><h2>{w}</h2><p>{m}<p>{s}<ul><li>{s}<li>{w}</ul><p>{l}</div><aside>{w} <a href=q>{w}</a></aside></main><section id=comments><p>{m}<p>{s}</section>",
    "<body><div class=cookie-notice>{m}</div><div><p data-main>{l}</p><p data-main>{s}</p><p data-main>{m}</p><p data-main>{s}</p></div><ul><li><a href=1>{w}</a><li><a href=2>{w}</a></ul><div>{w}</div>",
    "<body><div><a href=1>{w}</a> <a href=2>{w}</a> <a href=3>{w}</a></div><h1 data-main>{w}</h1><p data-main>{l}</p><h2 data-main>{w}</h2><p data-main>{m}</p><p><a href=4>{w}</a></p><div>{w}</div>",
    "<body><article><div data-main><h1>{w}</h1><p>{s}<p>{l}<p>{m}</div><div class=share>{w}</div><form>{w} <input></form><div class='comment-list'><p>{m}<p>{s}</div></article>",
    "<body><article data-main><p>{s}<p>{s}<p>{l}<p><a href=x>{w}</a><p>{m}</article><div>{w}</div><p>{m}</p>",
    "<body><div id=sidebar><p>{m}</div><div class=content data-main><p>{l}<p>{s}<blockquote>{m}</blockquote><p>{m}</div><div class=newsletter>{s}</div>",
    "<body><table><tr><td data-main>{l} {m}</td></tr><tr><td><a href=1>{w}</a> <a href=2>{w}</a></td></tr></table><p data-main>{m}</p>",
    "<body class='post has-sidebar'><header><h1>{w}</h1></header><article class='post category-social' data-main><h1>{w}</h1><p>{l}<p>{s}<p>{m}</article><div class=sidebar><p>{m}</div>",
    "<body><div id=content class=no-sidebar data-main><h1>{w}</h1><p>{l}<p>{s}<p>{m}</div><div class=footer>{m}</div>",
    "<body><main><div class=legal-notice data-main><h1>{w}</h1><p>{l}<p>{m}<p>{s}</div><div class='related-box'><p>{s}</div></main>",
    "<body><div class=search-page><div data-main><h1>{w}</h1><p>{m}<p>{l}<p>{s}</div></div><footer>{w}</footer>",
    "<body><article><div data-main><h1>{w}</h1><p>{m}<p>{l}<p>{m}</div><div class=box7>{s}</div><p data-main>{m}<p data-main>{s}</article>",
    "<body><article><h1 data-main>{w}</h1><p data-main>{l}<p data-main>{m}</p><div class=x1>{w}</div><p data-main>{m}<p data-main>{s}</p><div>{m}</div></article><div>{w}</div>",
    "<body><div class=wrap><div class=body data-main>{l}<br><br>{m}</div><div data-main>{m}</div><div class=comments><div>{m}</div><div>{s}</div></div></div>",
    "<body><article data-main><div>{l}</div><div>{m}</div><div>{s}</div><div>{l}</div></article><nav><a href=1>{w}</a></nav>",
    "<body><div class=header><a href=1>{w}</a></div><div><h1 data-main>{w}</h1><p data-main>{m}<p data-main>{l}</div><div class=reviews-and-comments><p>{s}<p>{m}</div><div class=copyright>{w}</div>",
    "<body><main><h1 data-main>{w}</h1><p data-main>{m}<div class=promo><p>{s}</div><p data-main>{l}<div class=notice><p>{m}</div><p data-main>{s}</main><aside><p>{m}</aside>",
    "<body><article><header><h1 data-main>{w}</h1><p data-main>{s}</header><p data-main>{l}<figure><figcaption data-main>{s}</figcaption></figure><p data-main>{m}<aside>{m}</aside><p data-main>{s}</article>",
    "<body><div role=main data-main><h3>{w}</h3><p>{s}<p>{l}<pre>{m}</pre><p>{m}</div><div role=contentinfo>{w}</div><div hidden><p>{l}</div>",
    "<body><article data-main><p>{s}</article><div class=banner>{m}</div>",
    "<body><article data-main><h1>{w}</h1><p><b>{w}<br><p>{s}</article><footer>{s}</footer><div class=ad>{s}</div>",
    "<body><div id=main-content data-main><p>{l}<ol><li>{s}<li>{m}<li>{s}</ol><table><tr><td>{w}<td>{w}<tr><td>{s}<td>{w}</table><p>{m}</div><div id=toolbar><ul><li><a href=1>{w}</a><li>{w}</ul></div>",
    "<body><div class=article-paywall-free data-main><p>{l}<p>{m}<p>{s}</div><div class=subscribe><p>{s}</div><p class=copyright>{w}",
    "<body><div class=text data-main>{l}<br><br>{l}<p>{s}<p>{m}</div><div class=meta>{w}</div><footer>{w}</footer>",
    "<body><div data-main><div>{l}</div><p>{m}</p><div>{m}</div><h2>{w}</h2><div>{l}</div></div><ul><li><a href=1>{w}</a></ul>",
    "<body><article data-main><p>{w}<p>{w}<p>{s}</article>",
    "<body><article data-main><h1>{w}</h1><p>{w}</p></article>",
    "<body><p data-main>{s}",
    "<body><p data-main>{m}<p data-main>{w}",
    "<body><div><p>{m}<p>{s}</div><article data-main><p>{s}<p>{w}<p>{m}</article><div><p>{s}<p>{m}</div>",
    "<body><section><h2>{w}</h2><p>{m}</section><main data-main><h1>{w}</h1><p>{m}<p>{s}</main><section><h2>{w}</h2><p>{s}<p>{w}</section><p>{m}",
    "<body><nav>{w} {w}</nav><article data-main><h1>{w}</h1><p>{s}<p>{s}</article><section><p>{l}<p>{m}</section>",
    "<body><table><tr><td><a href=1>{w}</a><td data-main>{m} {l}<td>{w}</table>",
    "<body><article data-main><h1>{w}</h1>{l}<br><br>{m}</article><div>{w}</div>",
    "<body><p><a href=1>{w}</a><p>{w}<p><a href=2>{w}</a> <a href=3>{w}</a><h1 data-main>{w}</h1><p data-main>{l}<p data-main>{w}<p data-main>{m}<p data-main>{w}<p data-main>{l}<p><a href=4>{w}</a><p>{s}<p><a href=5>{w}</a><p>{w}",
    "<body><ul><li><a href=1>{w}</a><li>{w}<li><a href=2>{w}</a></ul><p data-main>{l}<ul><li data-main>{w}<li data-main>{s}<li data-main>{w}</ul><p data-main>{m}<ul><li><a href=1>{w}</a><li>{s}<li><a href=2>{w}</a></ul>",
    "<body><p data-main>{m}<p data-main>{s}<p data-main>{l}<p data-main>{w}<p data-main>{m}<p><a href=1>{w}</a><p>{w}<p><a href=2>{w}</a>",
    "<body><h2><a href=1>{w}</a></h2><p>{s}<h2><a href=2>{w}</a></h2><h1 data-main>{w}</h1><p data-main>{m}<h2 data-main>{w}</h2><p data-main>{s}<p data-main>{l}<h2><a href=1>{w}</a></h2><p>{w}<h2><a href=2>{w}</a></h2>",
    "<body><nav><a href=1>{w}</a></nav><article data-main><h1><a href=0>{w} {w}</a></h1><p>{m}<p><a href=2>{s}</a><p>{l}<p><a href=3>{m}</a><p>{s} <a href=4>{s}</a></article><footer><a href=5>{s}</a></footer>",
    "<body><main data-main><h2><a href=0>{s}</a></h2><p><a href=2>{m}</a><p>{l}<ul><li><a href=3>{s}</a><li>{s}</ul></main><div><a href=5>{s}</a></div>",
    "<body class=x><header><h1>{w}</h1></header><div class=post data-main><h1>{w}</h1><p>{m}<p>{s}</div><div class=sidebar><p>{m}</div>",
    "<body><header><p>{m}</header><div data-main><p>{l}<p>{w}<p>{s}</div><form><p>{m}<p>{s}</form><footer><p>{m}</footer>",
    "<body><nav><a href=1>{w}</a></nav><div id=x data-main><h1>{w}</h1><p>{s}<p>{s}</div><aside><p>{m}<p>{s}</aside><nav><p>{m}</nav>",
    "<body><nav><a href=1>{w}</a></nav><section data-main><h1>T</h1><p>{s}<p>{s}</section>",
    "<body><nav><a href=1>x</a></nav><div data-main><h1>T</h1><p>{m}<p>{s}<p>{w}</div><footer>{s}</footer>",
    "<body><dialog><p>{m}</dialog><p data-main>{s}<p data-main>{w}<p data-main>{m}<menu><li>{w}</menu><footer><p>{m}</footer>",
    "<body><div data-main><p>{l}</p><p>{w}</p></div><form><p>{m}</p></form><footer>{l}</footer><aside><h2>{w}</h2><p>{l}</p></aside>",
    "<body><div role=banner><p>{m}</div><div data-main><h2>{w}</h2><p>{m}<p>{m}</div><div style='display:none'><p>{m}</div><fieldset><p>{s}</fieldset>",
)

#: Pages by template, each template filled in three ways.
SAMPLES = tuple(tuple(_fill(t, turn) for turn in range(3)) for t in _TEMPLATES)
