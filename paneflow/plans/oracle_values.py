"""Fixed values as the SQL checks state them: written out apart from the engine's own tables, so that a slip shows."""

from __future__ import annotations


def _pairs(text: str) -> dict[str, str]:
    words = text.split()
    return dict(zip(words[::2], words[1::2]))


TAG_ROLES = _pairs("""
article article aside complementary button button datalist listbox dd definition details group dialog dialog dt term
fieldset group figure figure form form h1 heading h2 heading h3 heading h4 heading h5 heading h6 heading hr separator
html document img img li listitem main main math math menu list meter meter nav navigation ol list optgroup group
option option output status p paragraph progress progressbar search search summary button table table tbody rowgroup
td cell textarea textbox tfoot rowgroup th columnheader thead rowgroup tr row ul list
""")
INPUT_ROLES = _pairs("""
button button checkbox checkbox email textbox image button number spinbutton radio radio range slider reset button
search searchbox submit button tel textbox text textbox url textbox
""")
INTERACTIVE_ROLES = "button checkbox combobox link listbox menuitem option radio searchbox slider spinbutton switch tab textbox".split()
AFFORDANCE_ROLES = "button link textbox combobox checkbox radio switch tab menuitem searchbox".split()
AFFORDANCE_VERBS = _pairs("link navigate textbox type searchbox type spinbutton type checkbox toggle radio toggle switch toggle combobox select listbox select option select button click menuitem click tab click slider drag")
REGIONS = {
    "landmark": "navigation main banner contentinfo complementary region search".split(),
    "form": ["form"],
    "list": "list listbox menu menubar".split(),
    "table": "table grid treegrid".split(),
}
SALIENCY = {"heading": 1.0, "banner": 0.9, "main": 0.6, "button": 0.8, "link": 0.6, "img": 0.7, "image": 0.7, "navigation": 0.5, "search": 0.7, "alert": 1.0, "status": 0.6, "dialog": 0.9}
NAMED_COLORS = _pairs("transparent #00000000 black #000000 white #ffffff red #ff0000 green #008000 blue #0000ff")
DURABLE = ["data-testid", "id", "href", "name"]
HINTS = [("data-testid", "explicit_test_id", "cross_capture_candidate", 0.98, 0.95), ("id", "stable_dom_id", "cross_capture_candidate", 0.9, 0.85), ("href", "href_or_form_name", "route_version", 0.7, 0.8), ("name", "href_or_form_name", "route_version", 0.65, 0.8)]
WITHHELD = "pii secret credential redacted".split()
FAIL_CLOSED = "pii secret credential".split()
PX = {"px": 1.0, "in": 96.0, "cm": 96.0 / 2.54, "mm": 96.0 / 25.4, "q": 96.0 / 25.4 / 4, "pt": 96.0 / 72.0, "pc": 16.0}
CATEGORY = {"color": "color", "background-color": "color", "font-size": "typography", "line-height": "typography", "border-radius": "radii", "margin-top": "spacing", "padding-left": "spacing"}
TOKENS = [
    ("color.brand", "color", "#0b5fff", None), ("color.ink", "color", "#1a1a1a", None), ("color.paper", "color", "#ffffff", None), ("color.warn", "color", "#7a2e00", None),
    ("radius.md", "radii", None, 8.0), ("radius.sm", "radii", None, 4.0), ("space.lg", "spacing", None, 24.0), ("space.md", "spacing", None, 16.0), ("space.sm", "spacing", None, 8.0),
    ("type.body", "typography", None, 16.0), ("type.small", "typography", None, 14.0), ("type.title", "typography", None, 20.0),
]
