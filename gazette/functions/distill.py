"""What distilling knows of sites: elements that are never content, names of furniture, lines that sites add."""

from __future__ import annotations

VERSION = 1
LEAST_WORDS = 80
# Elements that are never content.
CHROME = ("nav", "footer", "button", "noscript", "form", "title", "meta", "link", "style", "script", "template")
#: Class and id names of furniture, from conventions that are public: landmark and widget roles of ARIA, the parts of a page that
#: schema.org names (its ad block, footer, side bar and navigation), components of common style sheets and of common publishing
#: themes; and `ad`, which pages of the test tables use.
ROLES = "alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar tooltip"
PARTS = "ad advert advertisement footer sidebar"
COMPONENTS = "breadcrumb carousel dropdown modal navbar offcanvas pagination popover popup toast"
THEMES = "comment cookie login newsletter promo related share sharing social sponsored subscribe tag-cloud widget"
FURNITURE = sorted({*ROLES.split(), *PARTS.split(), *COMPONENTS.split(), *THEMES.split()})
NAMED = r"(?:^|[\s_-])(?:" + "|".join(FURNITURE) + r")s?(?:$|[\s_-])"
#: Lines that a site adds to articles, by language: a paragraph that begins with one goes, whatever its length.
SITE_LINES = {
    "en": r"(?i)^(?:read more|read also|share this|all rights reserved|follow us|sign up|advertisement)(?![\p{L}\p{N}_])",
    "de": r"(?i)^(?:mehr zum thema|lesen sie auch|alle rechte vorbehalten|anzeige|folgen sie uns|teilen)(?![\p{L}\p{N}_])",
    "fr": r"(?iu)^(?:lire aussi|tous droits réservés|partager|suivez-nous|publicité|abonnez-vous)(?![\p{L}\p{N}_])",
    "es": r"(?iu)^(?:lea también|todos los derechos reservados|compartir|síguenos|publicidad|suscríbete)(?![\p{L}\p{N}_])",
    "it": r"(?iu)^(?:leggi anche|tutti i diritti riservati|condividi|seguici|pubblicità|abbonati)(?![\p{L}\p{N}_])",
}
