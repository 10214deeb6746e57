"""Labelled training texts for the personal-data field: made here from patterns, never taken from the data.

``examples`` is a deterministic generator. A text is a list of (piece, label) with the labels of ``pii.LABELS``.
"""

from __future__ import annotations

import random

# Given names of many languages.
GIVEN_NAMES = """Agnes Ahmed Aisha Akira Alan Alejandro Alice Amelie Amir Ana Andrea Andrew Anika Anna Annika Antonio Arjun Astrid Beatrice
Ben Bianca Boris Brian Bruno Camille Carla Carlos Caroline Charlotte Chiara Chloe Clara Claudia Claire Daniel Daria David Diana Diego Dmitri
Edward Elena Elif Elisa Ella Emil Emily Emma Erik Esther Eva Fatima Felix Fiona Francesca Frank Frieda Gabriel George Giorgio Giulia Grace Greta
Hannah Hans Hassan Helen Helena Henry Hiroshi Hugo Ibrahim Igor Ines Ingrid Irene Isabel Ivan Jack Jakob James Jan Jane Jasmin Joana Johan John
Jonas Jose Julia Julien Karim Karl Katrin Kenji Khalid Kim Laila Lars Laura Leila Lena Leo Lina Lisa Louis Luc Lucia Ludwig Luis Luka Maja
Malik Marco Maria Marie Marina Mario Mark Marta Martin Mary Mateo Matthias Max Mei Mia Michael Miguel Mila Mohamed Monika Nadia Natasha Niklas Nina
Noah Nora Olga Olivia Omar Oscar Otto Paolo Patricia Paul Paula Pavel Pedro Peter Petra Philip Pierre Priya Rachel Ravi Robert Rosa Ruth Samir Samuel
Sara Sarah Sergei Simon Sofia Sophie Stefan Susan Sven Tariq Teresa Thomas Tom Valentina Vera Victor Walter Yuki Yusuf Zoe""".split()
# Titles before a family name.
TITLES = ["Dr.", "Mrs", "Mr", "Ms", "M.", "Mme", "Herr", "Frau", "Prof.", "Sr.", "Sra.", "Mr.", "Mrs.", "Ms.", "Dott.", "Sig."]
# Words of streets, before or after their name.
STREET_AFTER = "Street Road Lane Avenue Drive Close Way Court Ct. Blvd Boulevard Square Terrace Place Crescent Row Gardens Hill St. Ave. Rd.".split()
STREET_BEFORE = ["rue", "avenue", "place", "chemin", "boulevard", "Via", "Viale", "Piazza", "Calle", "Avenida", "Plaza", "Rua", "Travessa", "Largo"]
STREET_ENDS = ["straße", "strasse", "weg", "gasse", "platz", "allee", "laan", "straat", "ring", "damm"]
_SYL = "bal ber bru cas cor dal den dor el far fen gar gol hal har hen jor kar kel kor lam lin lor mal mar mon mor nar nel nor ost pel per quin ran rol rut sal sel sor tal tam tor val vel vin wal wes yor zan".split()
_END = "berg mont son sen wick ham stad mann sky elli ini ardo feld bury qvist hurst iden ova ano etti ez es ski czyk ley ton ford er oni ov strom gaard sson".split()
_PLAIN = "report summary layout panel theme notes draft market suite team settings template digest column mode release garden river harbor north south winter meeting sprint budget owner access guide music archive table menu filter search upload office kitchen event travel camera printer station bridge valley forest sunset tower signal castle phone mail street avenue address apartment name passport id license tel fax".split()
_VERBS = "Open Close Save Sort Filter Share Edit Remove Add Create Contact Call Write Send Review Update Page Row Total Last Level Version Build Ratio Click Read".split()
_TOWNS = "Port Kestrel Saint North West East New Old Upper Lower".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return self.r.choice(_SYL) + self.r.choice(["", self.r.choice(_SYL)]) + self.r.choice(_END)

    def family(self) -> str:
        f = self.word().capitalize()
        k = self.r.random()
        return f"{f}-{self.word().capitalize()}" if k < 0.15 else f"{self.r.choice(['van', 'von', 'de', 'di', 'da'])} {f}" if k < 0.22 else f

    def person(self) -> str:
        g, f, k = self.r.choice(GIVEN_NAMES), self.family(), self.r.random()
        if k < 0.2:
            return f"{self.r.choice(TITLES)} {f}"
        if k < 0.3:
            return f"{f}, {g}"
        if k < 0.35:
            return f"{f.upper()}, {g}"
        if k < 0.45:
            return f"{g} {self.r.choice('ABCDEFGHJKLMNPRST')}. {f}"
        return f"{g} {f}"

    def email(self) -> str:
        g, f = self.r.choice(GIVEN_NAMES), self.word()
        user = self.r.choice([f"{g}.{f}".lower(), f"{g}.{f.capitalize()}", f"{g}-{f}".lower(), f"{g[0]}{f}".lower(), f"{f}_{self.digits(2)}", f"{g}+{self.r.choice(['news', 'ops', 'test', 'shop'])}".lower(), f"{g}{self.digits(2)}".lower()])
        host = self.r.choice([f"{self.word()}.{self.r.choice(['example', 'com', 'org', 'test', 'invalid', 'net', 'de'])}", f"mail.{self.word()}.example", f"{self.word()}-{self.r.choice(['office', 'desk', 'web'])}.example", f"uni.{self.word()}.example"])
        k = self.r.random()
        if k < 0.12:
            return f"{user} [at] {host.replace('.', ' [dot] ')}"
        if k < 0.22:
            return f"{user} (at) {host}"
        if k < 0.28:
            return f"{user} @ {host}"
        return f"{user}@{host}"

    def phone(self) -> str:
        d = self.digits
        return self.r.choice(
            [
                f"+1{d(10)}", f"+1 {d(3)}-555-{d(4)}", f"1 {d(3)} 555 {d(4)}", f"({d(3)}) 555-{d(4)}", f"{d(3)}-555-{d(4)}", f"{d(3)}.555.{d(4)}", f"{d(3)}-555-{d(4)} ext. {d(3)}", f"{d(3)}-{d(3)}-{d(4)}",
                f"+44 7700 {d(6)}", f"07700 {d(3)} {d(3)}", f"020 7946 {d(4)}", f"+33 6 39 98 {d(2)} {d(2)}", f"01 99 00 {d(2)} {d(2)}", f"+49 (0)30 23125-{d(3)}", f"030/23125{d(3)}", f"0491 570 {d(3)}", f"+39 06 {d(4)} {d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"+31 20 {d(3)} {d(4)}",
            ]
        )

    def number(self) -> list[tuple[str, str]]:
        """An identity number, with its words in front or, for social security numbers, without."""
        d, up = self.digits, self.r.choice("ABCDEFGHJKLPTXZ")
        ssn = self.r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"9{d(8)}"])
        if self.r.random() < 0.25:
            return [(f"9{d(2)}-{d(2)}-{d(4)}", "ID")]
        lead, no = self.r.choice(
            [
                ("SSN ", ssn), ("SSN: ", ssn), ("social security number ", ssn), ("Steuer-ID ", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("tax ID ", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("national ID ", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("DNI ", f"{d(8)}-{up}"), ("DNI ", f"{d(8)}{up}"), ("NIF ", f"{d(9)}"),
                ("passport no. ", f"{up}{d(7)}"), ("Passport ", f"{up}{self.r.choice('ABC')}{d(6)}"), ("Ausweisnummer ", f"{up}{d(2)}X{d(5)}"), ("n° de sécurité sociale ", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}"), ("driver's licence ", f"{up}{d(3)}-{d(4)}-{d(4)}"), ("driving licence ", f"{up}{d(3)}-{d(4)}-{d(4)}"), ("codice fiscale ", f"{self.word()[:6].upper()}{d(2)}{up}{d(2)}{up}{d(3)}{up}"), ("BSN ", d(9)),
            ]
        )
        return [(lead, "O"), (no, "ID")]

    def town(self) -> str:
        w = self.word().capitalize()
        return self.r.choice([w, w, f"{self.r.choice(_TOWNS)} {w}", f"{w} Bay", f"Sainte-{w}", f"{w}moor"])

    def address(self) -> str:
        n, w, zip5, t = self.r.randint(1, 250), self.word().capitalize(), "00" + self.digits(3), self.town()
        k = self.r.random()
        if k < 0.32:
            street = self.r.choice([f"{w} {self.r.choice(STREET_AFTER)}", f"Old {w} {self.r.choice(STREET_AFTER)}", f"N. {w} {self.r.choice(STREET_AFTER)}"])
            head = f"{n} {street}"
            return self.r.choice([head, f"{head}, {t} {zip5}", f"{head}\n{t} {zip5}", f"{head}, {t}", f"{n}{self.r.choice('ABC')} {street}, Apt {self.r.randint(1, 40)}, {t}", f"Flat {self.r.randint(1, 40)}, {head}\n{t}", f"Flat {self.r.randint(1, 40)}, {head}"])
        if k < 0.5:
            street = self.r.choice([w + self.r.choice(STREET_ENDS), f"Am {w}", f"Alter {w}", f"Zum {w}", f"{self.r.choice(['Linden', 'Quellen', 'Hof', 'Garten'])}{self.r.choice(STREET_ENDS)}"])
            return self.r.choice([f"{street} {n}, {zip5} {t}", f"{street} {n}"])
        if k < 0.65:
            street = f"{self.r.choice(['rue', 'avenue', 'place', 'chemin', 'boulevard'])} {self.r.choice(['des ', 'de la ', 'du ', ''])}{w}"
            return f"{n}{self.r.choice(['', '', ' bis', ' ter'])} {street}, {zip5} {t}"
        if k < 0.8:
            return f"{self.r.choice(['Via', 'Calle', 'Avenida', 'Rua', 'Viale'])} {self.r.choice(['del ', 'da ', 'de la ', ''])}{w}, {n}, {zip5} {t}"
        return self.r.choice([f"P.O. Box {self.digits(4)}, {t} {zip5}", f"PO Box {self.digits(4)}, {t}", f"P.O. Box {self.digits(4)}"])

    def other(self) -> str:
        """A text without personal data, many of them numbers or capitalised words."""
        d, r = self.digits, self.r
        title = lambda: " ".join(x.capitalize() for x in r.sample(_PLAIN, r.choice([1, 2, 2, 3])))
        return r.choice(
            [
                lambda: f"Invoice no. {d(9)}", lambda: f"Tracking {d(11)}", lambda: f"Version {d(2)}.{d(4)}", lambda: f"Build {d(3)}.{d(2)}.{d(4)} passed", lambda: f"Total {d(3)}.{d(2)} EUR", lambda: f"Ticket #{d(7)}", lambda: f"Row {d(3)}, column {d(2)}", lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
                lambda: f"ISBN-like {d(3)}-{d(1)}-{d(4)}-{d(2)}-{d(1)}", lambda: f"SKU {d(3)}-{d(2)}-{d(4)}", lambda: f"Order {d(3)}-{d(2)}-{d(4)} shipped", lambda: f"Order no. {d(8)}", lambda: f"Parcel {d(12)}", lambda: f"Room {d(2)}, Level {d(1)}", lambda: f"Page {d(2)} of {d(3)}", lambda: f"{d(3)}×{d(4)} px",
                lambda: f"@media (min-width: {d(3)}px)", lambda: f"2025-0{r.randint(1, 9)}-{r.randint(10, 28)} 09:{d(2)}", lambda: f"Ratio {d(2)}:{d(1)}", lambda: f"{d(2)} Main themes", lambda: f"{d(2)} {title()}", lambda: f"Last {d(2)} days", lambda: f"192.0.2.{d(2)}", lambda: f"commit {r.choice('abcdef')}{d(5)}{r.choice('abcdef')}{d(3)}",
                lambda: f"Open {d(2)} hours", lambda: title(), lambda: title(), lambda: f"{r.choice(_VERBS)} {' '.join(r.sample(_PLAIN, 2))}", lambda: f"{r.choice(_VERBS)} to {r.choice(_PLAIN)}", lambda: f"Team {self.word().capitalize()}", lambda: f"{r.choice(_PLAIN).capitalize()} {self.word().capitalize()} Market", lambda: "npm install @grid/core", lambda: f"user@{d(1)}x.png",
                lambda: "[redacted]", lambda: "••••••", lambda: "Tel. column hidden", lambda: "ID column", lambda: "Contact us", lambda: f"Address line {d(1)}", lambda: "Street view", lambda: "Avenue template", lambda: "Call to action", lambda: "Mail settings", lambda: "Sort by owner", lambda: "Name", lambda: self.word().capitalize(), lambda: f"{r.choice(['May', 'April', 'June', 'Grace', 'Summer'])} {r.choice(['Release', 'period', 'Sale', 'Edition'])}",
                lambda: f"Apartment {r.choice(_PLAIN)}", lambda: "Passport photos", lambda: "Phone layout", lambda: "Fax queue", lambda: f"{d(3)} {r.choice(_PLAIN)}", lambda: f"Stock no. {d(3)}-{d(2)}-{d(4)}", lambda: f"Booking {d(3)}-{d(2)}-{d(4)}", lambda: f"Port {d(4)}", lambda: f"{r.choice(_VERBS)} {title()}",
            ]
        )()

    def text(self) -> list[tuple[str, str]]:
        r = self.r
        name, mail, phone, address = (lambda: [(self.person(), "NAME")]), (lambda: self._mail()), (lambda: [(self.phone(), "PHONE")]), (lambda: [(self.address(), "ADDRESS")])
        o = lambda s: [(s, "O")]
        one = lambda *xs: o(r.choice(xs))
        shapes = [
            lambda: one("Ship to ", "Reviewed by ", "Avatar of ", "handed over from ", "Approved: ", "Assigned to ", "Ask ", "Liebe Grüße, ", "Merci à ", "Best regards, ", "Signed by ", "Author: ", "Thanks ", "Gracias a ", "Owner: ") + name() + one("", "", " yesterday", " about the spacing scale", " pour la relecture", " for the help", " (owner)", " last week"),
            lambda: name() + one(" commented on the draft", " (owner)", " joined the team", "", " replied", " left a note"),
            lambda: name() + o(r.choice([", ", ": ", " · "])) + phone(),
            lambda: name() + o(" <") + mail() + o(">"),
            lambda: one("Ship to ", "Deliver to ", "Guest ") + name() + o("\n") + address(),
            lambda: one("Signed in as ", "Kontakt: ", "Write to ", "Invite sent to ", "Copie envoyée à ", "reset link goes to ", "Reply-to: ", "") + mail() + one("", "", " for access", ", check spam", " (verified)"),
            lambda: one("Call ", "Tel. ", "Text ", "Fax: ", "mobile ", "Rückruf unter ", "Phone ", "Téléphone : ", "") + phone() + one("", "", " before noon", " if the gate is shut", " / desk busy", " erbeten"),
            lambda: one("Please call ", "Reach me at ") + phone() + o(" or write to ") + mail() + one(", thanks", ""),
            lambda: one("Emergency contact ", "Contact ") + name() + o(": ") + phone() + o(" or ") + mail(),
            lambda: mail() + o(" / ") + phone() + o(" / ") + address(),
            lambda: one("Holder: ", "Verified with ", "Applicant gave ", "", "Checked: ") + self.number() + one("", "", " on file", " as proof"),
            lambda: o("Guest ") + name() + o(" checked in with ") + self.number() + o("; lives at ") + address(),
            lambda: one("lives at ", "pick up at ", "Delivery at ", "Moved from ", "Wohnhaft: ", "Lieu : ", "Ship to: ", "", "") + address() + one("", "", " after 5pm", " last spring"),
            lambda: o(self.other()), lambda: o(self.other()), lambda: o(self.other()), lambda: o(self.other()), lambda: o(self.other()), lambda: o(self.other()),
        ]
        out: list[tuple[str, str]] = []
        for k in range(r.choice([1, 1, 1, 2, 2, 3])):
            if k:
                out += o(r.choice([". ", "; ", " | ", " — ", "\n", " · "]))
            out += r.choice(shapes)()
            if r.random() < 0.15:
                out += one(" · new", " · updated", " · see notes", " · click to expand", " · 3 min ago")
        return [p for p in out if p[0]]

    def _mail(self) -> list[tuple[str, str]]:
        m, k = self.email(), self.r.random()
        return [("mailto:", "O"), (m, "EMAIL")] if k < 0.08 else [("<", "O"), (m, "EMAIL"), (">", "O")] if k < 0.18 else [(m, "EMAIL")]


def examples(n: int, seed: int = 5) -> list[list[tuple[str, str]]]:
    """n texts; about a third of them repeat an earlier piece of the text, as documents do."""
    m = Maker(seed)
    out = []
    for _ in range(n):
        t = m.text()
        if m.r.random() < 0.3:
            said = [p for p in t if p[1] in ("NAME", "ID", "PHONE")]
            t = t + [("\n", "O")] + (([m.r.choice(said)] if said and m.r.random() < 0.6 else m.text()))
        out.append(t)
    return out
