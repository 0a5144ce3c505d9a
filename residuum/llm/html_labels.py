"""The small labelled table on which the block classifier is trained.

A few hand-made page layouts; ``+`` marks lines whose blocks are main text, ``-``
lines whose blocks are not, a space plain structure. ``{n}`` stands for n filler words,
``{n@}`` for n words that are links.
"""

from __future__ import annotations

import re

from residuum.llm.html_blocks import blocks, features

LAYOUTS = (
    """
 <html><head><title>T</title></head><body>
- <header><div>{3}</div><nav><ul><li>{1@}</li><li>{1@}</li><li>{2@}</li></ul></nav></header>
- <div class="ad">{9}</div>
 <article>
+ <h1>{8}</h1><p>{60}</p><p>{3}</p><p>{45}</p><p>{2}</p><ul><li>{6}</li><li>{4}</li></ul><blockquote>{20}</blockquote>
- <aside>{12}</aside><div class="share">{4@}</div>
+ <h2>{3}</h2><p>{30}</p><p>{1}</p><p>{80}</p>
 </article>
- <footer>{7}</footer></body></html>""",
    """
 <body>
- <nav><a href="/">{1@}</a> {4@}</nav><div class="cookie-notice">{25}</div><div id="sidebar">{6@}<p>{30}</p></div>
 <main>
+ <h1>{5}</h1><p>{4}</p><p>{25}</p><pre>{10}</pre><table><tr><td>{2}</td><td>{1}</td></tr></table><p>{70}</p>
- <form><p>{8}</p></form>
+ <p>{12}</p>
- <section class="comments"><h3>{2}</h3><p>{40}</p><p>{3}</p><p>{22}</p></section>
 </main>
- <footer><p>{40}</p><p>{2} {3@}</p></footer></body>""",
    """
 <body>
- <div>{1@} {1@} {2@}</div><div>{2@}</div><div>{2}</div>
+ <div><h1>{6}</h1></div><div>{50}</div><div>{40}</div><p>{20}</p><div>{90}</div><p>{14}</p><p>{35}</p>
- <div>{5@}</div><div>{4@} {1}</div><div>{3}</div></body>""",
    """
 <body>
- <ul><li>{1@}</li><li>{2@}</li><li>{1@}</li></ul><p>{2}</p>
+ <p>{33}</p><p>{28}</p><p>{9}</p><p>{41} {2@}</p><p>{17}</p>
- <p>{6@}</p><p>{3} {3@}</p><ul><li>{4@}</li><li>{5@}</li></ul><p>{4}</p></body>""",
    """
 <body>
- <div class="banner">{15}</div><div role="navigation">{3@}</div><div class="newsletter"><p>{20}</p><p>{3}</p></div>
 <div class="post-content">
+ <h1>{4}</h1><p>{2}</p><p>{5}</p><p>{48}</p><p>{3} {4@} {10}</p><p>{6@}</p><p>{1}</p>
 </div>
- <div id="comments"><article><p>{30}</p></article><article><p>{4}</p></article></div><div class="related">{5@}<p>{18}</p></div>
- <div class="copyright">{8}</div></body>""",
    """
 <body><article>
+ <p>{1}</p>
 </article>
- <footer>{30}</footer></body>""",
    """
 <body>
- <div class="advert"><p>{55}</p></div>
 <article>
+ <h1>{10}</h1><p>{120}</p>
 </article>
- <aside><p>{60}</p><p>{8@}</p></aside><footer>{60}</footer></body>""",
    """
 <body>
- <p>{1}</p><p>{2@}</p><footer>{3}</footer></body>""",
    """
 <body>
+ <h1>{3}</h1><p>{22}</p><h2>{2}</h2><p>{31}</p><ul><li>{12}</li><li>{16}</li></ul><p>{26}</p>
- <div class="social">{3}</div></body>""",
    """
 <body><article>
+ <h1>{4}</h1><p>{2}</p><p>{40}</p><p>{1@} {2@}</p><p>{3}</p>
 </article>
- <footer>{5}</footer></body>""",
    """
 <body><main>
+ <p>{3}</p><p>{2}</p>
 </main>
- <div>{2}</div><nav>{2@}</nav></body>""",
    """
 <body><div class="overflow-hidden"><div class="content-sidebar-wrap">
- <div class="menu">{1@} {2@}</div><div class="sidebar"><p>{24}</p></div>
+ <h1>{5}</h1><p>{50}</p><p>{3}</p><p>{36}</p>
- <div class="share">{3@}</div></div></div>
- <footer>{9}</footer></body>""",
    """
 <body><div class="sidebar-right"><main>
+ <h1>{4}</h1><p>{65}</p><p>{2}</p><p>{33}</p>
 </main>
- <div class="widget"><p>{21}</p></div><div class="comments"><article><p>{26}</p></article></div></div></body>""",
    """
 <body>
- <p>{3}</p><p>{4}</p><p>{2}</p>
+ <p>{44}</p><p>{3}</p><p>{52}</p><p>{4}</p><p>{39}</p>
- <p>{2}</p><p>{5}</p><p>{3}</p><p>{24@}</p><p>{31@} {2}</p><p>{28@}</p></body>""",
    """
 <body>
- <div>{26@} {4}</div><div>{3}</div><div>{29@}</div>
+ <div>{30}</div><div>{4}</div><div>{61}</div><div>{3}</div><div>{27}</div>
- <div>{3}</div><div>{2}</div><div>{5}</div></body>""",
    """
 <body><article>
+ <h1>{4}</h1><p>{70}</p>
 </article>
- <div class="sidebar"><article><p>{28}</p></article></div></body>""",
)


def _filled(line: str) -> str:
    line = re.sub(r"\{(\d+)@\}", lambda m: "<a href='#'>" + " ".join(["word"] * int(m[1])) + "</a>", line)
    return re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), line)


def labelled_blocks() -> tuple[list[tuple], list[int]]:
    """Feature rows of every block of the layouts, and 1 for main text."""
    rows: list[tuple] = []
    labels: list[int] = []
    for layout in LAYOUTS:
        page = ""
        marks: list[int] = []
        for line in layout.strip("\n").split("\n"):
            page += _filled(line[1:])
            # the blocks that this line ends or holds carry its mark
            marks += [int(line[0] == "+")] * (len(blocks(page)) - len(marks))
        rows += features(blocks(page))
        labels += marks
    return rows, labels
