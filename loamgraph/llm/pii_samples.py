"""Invented texts with labelled spans, from which the character tagger is trained.

Values are made by rule (numbers, addresses, made-up surnames and domains) or drawn from short lists of common names; they
stand in sentence frames of many kinds, or take the place of a noun phrase in a plain sentence, so that a name may appear
in any context. Frames are split by a hash: one fifth is never used for training and serves to measure. Only the
training and the tests use this module; nothing here runs in a query.
"""

from __future__ import annotations

import random
import re
import zlib

Spans = list[tuple[int, int, str]]

# Common given names and surnames of several countries; many are words too.
GIVEN = (
    "Aaron Abigail Aisha Alice Amara Amelia Andrew Angela Anneke Antonio April Arthur Astrid Barbara Bartholomew Beatrice Bill Björn Bob Brian Callum Carlos Carmen Charlotte Chen Chidi Chiara "
    "Christopher Clarence Claire Daisy Daniel David Deepa Diego Dmitri Dorothy Edward Eleanor Elizabeth Emily Emma Ethan Faith Fatima Felicity Fiona Francesca François Frank Frederick Gabriel George "
    "Giulia Grace Grant Gwendolyn Hannah Hannelore Harriet Harry Hassan Heather Henry Hiroshi Holly Hope Howard Ibrahim Ines Ingrid Isaac Isabella Ivan Jack Jacob James Jasmine Jean Jennifer Jürgen "
    "Joan John Jonathan José Joseph Joy Julia Karen Katherine Kenneth Kofi Krzysztof Lars Laura Leila Leonard Lillian Lily Linda Liu Louise Lucas Magdalena Margaret Maria Mark Martha Mateo Matthew "
    "Max May Mei Michael Mohammed Nadia Natalie Nathaniel Nguyen Nicholas Noah Noor Octavia Oksana Olga Oliver Oscar Pablo Patrick Penelope Peter Philip Pierre Priya Rachel Raj Ravi Rebecca Renée "
    "Richard Robert Robin Rose Roy Ruby Samuel Sandra Sarah Sean Siobhan Sofia Stephen Susan Sven Takeshi Theodore Theresa Thomas Timothy Ursula Valerie Victoria Walter Will William Winifred Yusuf Zoë"
).split()
SURNAMES = (
    "Adams Ahmed Allen Andersson Bailey Baker Banks Barnes Becker Bell Bennett Berg Bianchi Bishop Black Bond Brook Brown Bush Butler Carter Castle Chan Chapman Clark Cole Collins Cook Cooper Costa Cross "
    "Davies Day Diaz Dubois Edwards Evans Featherstonehaugh Fernandes Field Fischer Fisher Ford Foster Fox Frost Garcia Gardner Gomez Gray Green Gupta Hall Hansen Harris Hayes Hill Hoffmann Hughes Hunt Ivanov "
    "Jackson Johansson Johnson Jones Kaur Khan Kim King Knight Kowalski Lake Lane Larsen Laurent Lee Lewis Li Long Lopez Marsh Marshall Martin Mason Meyer Miller Minh Moore Moreau Morris Müller Murphy Nakamura "
    "Nelson Novak Oakes Okafor Okonkwo Olsen Page Park Parker Patel Perez Peterson Petrov Pike Pond Porter Price Reed Reyes Rivers Roberts Rossi Ruiz Sanders Santos Sato Schmidt Schneider Scott Shah Sharma "
    "Silva Singh Smith Stone Summers Suzuki Swift Tanaka Taylor Thompson Turner Vargas Vogt Walker Wang Ward Waters Weber West White Williams Wilson Winter Wolf Wood Wright Yamamoto Yang Young Zhang Zimmermann"
).split()
PARTICLES = "van de von der di da al el van der de la".split(" ")
TOWNS = "Norwich Leeds Bristol Hamburg Lyon Springfield Oakdale Port Arthur|New Haven|Bad Kreuznach|Saint Albans|Upper Norwood|Mill Valley|Eastbourne|Göttingen|Redhill|Stonebridge".replace(" ", "|", 6).split("|")
STREET_WORDS = "Street St. St Road Rd Avenue Ave Lane Drive Close Court Way Place Square Crescent Terrace Grove Row Walk Mews Gardens Boulevard Hill".split()
STREETS = "Park Mill Church High Station Victoria Green Kings Queens Maple Oak Elm Old Mill|Long Meadow|North|Harbour|Castle|Bridge|Orchard|Cedar|Chapel|Market|Spring Garden".replace(" ", "|", 11).split("|")
HOUSES = "Rose Cottage,The Old Rectory,Mill House,Ivy Lodge,Seaview,Willow Barn".split(",")

# Frames: {n} name, {e} email, {p} phone, {i} labelled number, {a} address; the others are filled with things that are none of these.
FRAMES = """{n} signed the note.
The note was signed off by {n} and {n2}.
Prepared by {n} for the {noun} review.
Reviewed by {t}{n}, {month} {year}
signed {n}
Best wishes, {n}
Kind regards,\n{n}
From: {n} <{e}>
To: {e}, {e2}
cc {n}; {n2}
{n} and {n2} met near the {noun}.
We spoke with {t}{n} about the {noun}.
{t}{n} thinks the {noun} is late.
Thanks to {n}, the {noun} works again.
I asked {n} whether the {noun} was ready.
Patient: {n}
Patient name: {n}, admitted on {date}
Customer {n} complained about the {noun}.
{n}'s {noun} broke yesterday.
This is {n}'s own {noun}.
the {noun} belongs to {n}
Contact person: {n}, {p}
Contact {n} ({e}) about the {noun}.
Reach {n} on {p} or {e}.
{n} lives at {a}.
{n}, {a}, {p}
Attendees: {n}, {n2}, {n3}
Attending were {n}, {n2} and {n3}.
name={n};mail={e}
assignee={n} state=open
author: {n}
owner: {n} | team: {noun}
- {n} (chair)
* {n}: will bring the {noun}
1. {n} 2. {n2}
({n})
[{n}] fixed the {noun}
"{n}" was written on the {noun}.
According to a letter from {t}{n}, nothing changed.
A call from {n} came in the evening.
Yesterday {n} returned the {noun}.
Later that day {n} and the driver repaired the {noun}.
After lunch {t}{n} looked at the {noun} - and left.
New colleague for the {noun} - {n} - starts on {weekday}.
Dear {n},
Dear {t}{n}, thank you for the {noun}.
Hello {n}! How is the {noun}?
Is {n} still in charge of the {noun}?
Approved: {n}.
Signed by {n}; countersigned by {n2}.
Give the {noun} to {n} before {weekday}.
Have {n} check the {noun}.
{n} called.
{n} wrote to {e} and never heard back.
{n} owes {n2} a {noun}.
Witness {n} saw the {noun} at {time}.
our cousin {n} paid for the {noun}
Enrolled {t}{n}, {i}, resident at {a}.
{n} ({i}) applied for a {noun}.
Mail {e} for the {noun}.
My address is {e}.
Send the {noun} to {e}, please.
email: {e}
<{e}>
Sender {e} was blocked.
mailto:{e}?subject={noun}
Sign in as {e} with the usual password.
Ask {e} or {e2}.
write to {e}
The mailbox {e} is full.
Mail for {e} came back.
Questions? {e}
Call {p}.
Phone: {p}
Tel. {p} (after {time})
mobile {p}, evenings only
ring {p} about the {noun}
Text me on {p}!
Fax {p}
The hotline ({p}) was busy.
Missed a call from {p} while I fed the dog.
If nobody answers, try {p} instead.
My new number is {p}.
the number of the clinic is {p}
WhatsApp {p}
Reception: {p}, ext. 12
dial {p} for the {noun}
{p} is the line for the {noun}.
Please quote {i} for the {noun}.
{i}
His {i} was on the form.
Her {i} must be renewed.
The form shows {i}.
Wanted: {i} of the driver.
She gave {i} and left.
We live at {a}.
Address: {a}
Deliver the {noun} to {a}.
The parcel went to {a} by mistake.
moved to {a} in {month}
Visit us: {a}.
Meet me outside {a} at {time}.
Return to sender: {a}
Billing address {a}; shipping as before.
The {noun} was found near {a}.
Office: {a} (second floor)
Home is {a} now.
Property at {a}, sold in {year}.
Send it to {n}, {a}.
{w} {n} about the {noun}.
{w} {n}, please.
{w} {n}
{w} {n} {w2} the {noun}
{w}: {n}
{w}: {n}, {p}
{w} - {n} - {w2}
{w} {t}{n} on {weekday}
{w} {t}{n} to {w2} the {noun}
{w} {n} and {n2}
the {w2} {n} {w2} a {noun}
{n} {w2} the {noun}.
{n} {w2} {w2} the {noun}.
{t}{n} {w2} {w2} the {noun}.
{w} {w2} {n} {w2} {w2} a {noun}.
{n} and the {w2} {noun} {w2} at it.
{n} {w2} and {w2} it.
{n}, {w2} of the {noun}, is away.
{w2} by {n}
{w2} with {n}, mostly about the {noun}.
{w} {i}
{w} {w2} {i} {w2}
Their {i}.
Registered: {n}, {i}, {a}.
{n}, {i}, living at {a}
({i})
{w} {p}
{w} {p} {w2} the {noun}
{w} {w2} {p}, {w2}
{w} ({p}) {w2}
{p} or {p}
{e} or {p}
{n} uses {e} or {p}.
{w} {e}
{w} {e} {w2} the {noun}
{n} can be seen at {e} or {p}
{w} {w2} at {e}
{w} at {e}, {w2}
Reply-To: {e}
{w}: {e}, {w2} {w2}
{w} {a}
{w} at {a} {w2}.
{w} {w2} {a} {w2} {w2}.
{w}: {a}
living at {a}.
lives at {a} {w2}.
{w} at {a} {w2}
{w} to {a}.
{w} the {noun} to {a}.
{w} {p}, {w2} for the {noun}
{w2} {p}, {w2} {w2}""".split("\n")
FRAMES = [f.replace("\\n", "\n") for f in FRAMES]
OTHER = """Ticket {d3}-{d4}-{d2} is closed.
Ticket {d5} waits for {org}.
The build {d2}.{d3}.{d4} passed.
Build {d2}.{d1}.{d4} of {thing} failed.
Version {d1}.{d2}.{d1} is out.
Part {d4}-{d3}-{d2} is out of stock.
Item {d3} {d4} {d2} ships on {weekday}.
Receipt R-{d7} lists {d3} parts.
Invoice {d4}/{d3} is unpaid.
Order {d6} and order {d7} were merged.
A share of {d3}:{d4} fell to {d3}/{d2}/{d4} in spring.
Pressure between {d2}-{d3} bar is fine.
Valid from {date} to {date}.
At {time} the {noun} stopped; at {time} it ran again.
Row {d2} {d3} of the sheet is empty.
Record {d4} {d6}, address {d5} {d6}, cannot be read.
Hash 0x{hex} is stored.
commit {hex} broke the {noun}
SKU {d3}-{d4}-{d3}
Lot {d3} {d3} {d4} was recalled.
Serial {d3}-{d3}-{d4} is engraved on the {noun}.
The {noun} costs {d3}.{d2} euro, {d4} in total.
Population {d3},{d3},{d3} in {year}.
coordinates {d2}.{d6}, {d1}.{d6}
IP 10.{d2}.{d3}.{d1} is down, port {d4} too.
Ask @{handle} to join.
Install {pkg}@{d1}.{d2}.{d1} first.
Cron runs @daily and @{handle} agrees.
{thing} is new.
The {thing} {noun} shows {d3} units.
Our {thing} arrived; {thing} did not.
We use {thing} for the {noun}.
{org} sent a {noun}.
A letter from {org} came in {month}.
{org} and {org} signed a contract.
The {weekday} market in {town} was full.
We drove to {town} on {weekday}.
Project {thing} ends in {month} {year}.
See chapter {d2}, page {d3}.
It is called the {thing} {noun}, e.g. in {town}.
Meet at the {noun} at {d2} {month}.
at the dot of nine we left
look at the {noun} dot by dot
Internal Use Only
Daily Log, Morning Shift.
Social Security reform was discussed.
ID card offices close at noon.
The passport office is near the {noun}.
the road was long and the street was wet
Will the {noun} be ready in May?
The hill behind the {noun} was green, and the stone was grey.
Mark the page before you close the {noun}.
May we park near the {noun}?
Summer and winter, the cook used the {noun}.
The house at the corner has {d2} windows.
{d3} people walked along the road.
{w} no. {d4}-{d3}-{d2} {w2} the {noun}.
{w} {code}-{d7} {w2} {d3} {noun}.
{w} {code}-{d6} is unpaid.
{w} {code}{d5} {w2} the {noun}
the {w2} {d2} ;{d3} ;{d4} {w2}
The {w2} {w2} of the {thing} {w2}.
{w} {w2} only where {w2} {w2} of the {thing} are {w2}.
{w} {w2} {w2} to {w2} {w2}.
Reply-To: {w2}
{w} no. {d3}-{d2}-{d4}
no. {d4} of the {noun}
{w} {d3}-{d4}-{d2} {w2}
{w} {d5} {d6}, {w2} {w2}.
{w2}, offset {d5} {d6}, {w2}
value {d5} {d6} at position {d4}
{w} {d2}.{d3}.{d4} {w2} the {noun}
{w} meets in room {d2}, third floor.
room {d3}, building {d1}
{w} {d3} units {w2} the {noun}
{w} {d3} {noun} {w2}
{w} {thing} {w2} the {noun}
{w} {w2} {thing}, {w2}
Project {thing} {w2} in room {d1}.
{w} {w2}, {w2} {w2}.
Re: {w2} {w2}
The {street} market is open daily.
{w} {street} was closed all day.
walk along {street} to the {noun}""".split("\n")
NOUNS = "library budget sensor contract heater garden recipe engine archive pump battery schedule clinic training plan|memory graph|spare wheel|printer|report".replace(" ", "|", 12).split("|")
MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
ORGS = "Traders Foods Holdings Motors Bank Institute University Logistics Partners Council Hospital Airlines".split()


def held_out(frame: str) -> bool:
    """One frame in five is kept from the training."""
    return zlib.crc32(frame.encode()) % 5 == 0


class Maker:
    """Makes labelled texts from a seed and a list of plain sentences; train selects the frames and values to use."""

    def __init__(self, seed: int, plain: list[str], train: bool = True, shared: list[str] = ()):
        self.shared = shared
        self.r = random.Random(seed)
        self.plain = plain
        self.frames = [f for f in FRAMES if held_out(f) != train]
        words = {w for t in plain for w in re.findall(r"[^\W\d_]+", t) if w.islower() and len(w) > 1}
        self.words = sorted(words - {x.lower() for x in (*GIVEN, *SURNAMES)})
        self.names = [w for w in GIVEN if held_out(w) != train] if not train else GIVEN

    def _made(self, least: int = 2) -> str:
        c, v = "bcdfghklmnprstvwz", "aeiou"
        s = "".join(self.r.choice([*c, "br", "dr", "gr", "kr", "st", "th", "ch", "sh", "kl"]) + self.r.choice(v) + self.r.choice(["", "", "", "", "l", "r", "n", "s", "m", "t", "x"]) for _ in range(self.r.randint(least, 4)))
        return (s + self.r.choice(["", "r", "n", "ng", "rt", "lin", "sky", "son", "sk", "mer", "ff", "tt", "er", "s", "irs", "usk", "and", "ez"])).capitalize()

    def surname(self) -> str:
        s = self.r.choice(SURNAMES) if self.r.random() < 0.45 else self._made()
        u = self.r.random()
        if u < 0.06:
            return f"{s}-{self.r.choice(SURNAMES) if self.r.random() < 0.4 else self._made()}"
        if u < 0.12:
            return self.r.choice(["O'", "O’", "Mc", "Mac", "D'"]) + s
        return f"{self.r.choice(PARTICLES)} {s}" if u < 0.17 else s

    def name(self) -> str:
        r = self.r
        g = r.choice(self.names) if r.random() < 0.92 else self._made()
        if r.random() < 0.05:
            g += "-" + r.choice(GIVEN)
        s, u = self.surname(), r.random()
        i = r.choice("ABCDEFGHJKLMNPRSTW") + r.choice([".", ".", ".", ""])
        if r.random() < 0.03:
            s += r.choice([" Jr.", " Reyes", " Minh Khai"])
        return f"{g} {s}" if u < 0.5 else f"{g} {i} {s}" if u < 0.62 else f"{i[0]}. {s}" if u < 0.76 else f"{s}, {g}" if u < 0.86 else f"{s}, {i[0]}." if u < 0.89 else f"{g} {r.choice(GIVEN)} {s}" if u < 0.96 else f"{i[0]}. {r.choice('ABCEFJKLMR')}. {s}"

    def _typed(self) -> str:
        """A name as typed: now and then without capitals, or in capitals."""
        n, u = self.name(), self.r.random()
        t = n.lower() if u < 0.07 else n.upper() if u < 0.12 else n
        return t if len(t) == len(n) else n

    def email(self) -> str:
        r = self.r
        a, b = r.choice(GIVEN).lower(), r.choice(SURNAMES).lower() if r.random() < 0.4 else self._made().lower()
        a, b = ("".join(c for c in x if c.isascii()) for x in (a, b))
        user = r.choice([f"{a}.{b}", f"{a}{b}", f"{a}_{b}", f"{a}-{b}", f"{a[0]}{b}{r.randint(1, 99)}", a, f"{a}'{b}", f"{a}+{r.choice(['lab', 'news', 'home'])}", f"{b}{r.randint(1, 9999)}", f"{a}.{b[0]}"])
        host = r.choice([f"{r.choice(['mail', 'post', 'inbox', 'uni', 'firma', 'corp', 'gmail', 'yahoo', 'web'])}.{r.choice(['com', 'org', 'net', 'example', 'invalid', 'test', 'de', 'co.uk', 'io', 'example.org', 'example.edu'])}", f"{self._made().lower()}.{r.choice(['com', 'org', 'example', 'fr', 'test'])}", "example.org"])
        u = r.random()
        if u < 0.62:
            at, dot = "@", "."
        else:
            at = r.choice(["[at]", " [at] ", " (at) ", "(at)", " at ", " at ", " AT ", " AT ", "{at}"])
            dot = r.choice(["[dot]", " [dot] ", " (dot) ", " dot ", " dot ", " DOT "]) if at.strip().lower() == "at" or r.random() < 0.6 else "."
        s = user + at + host.replace(".", dot)
        return s.upper() if r.random() < 0.04 else re.sub(r"[A-Za-z]+", lambda m: m[0].title(), user) + at.lower() + host.upper().replace(".", dot) if r.random() < 0.03 and at == "@" else s

    def _d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        r, d = self.r, self._d
        two = " ".join(d(2) for _ in range(4))
        kinds = [
            f"+49 {r.choice(['30', '40', '89', '171', '221'])} {d(5)} {d(3)}", f"+49 (0) 30 {d(8)}", f"(030) {d(8)}", f"030/{d(7)}", f"0{d(3)} {d(6)}", f"+44 20 {d(4)} {d(4)}", f"+44 (0)20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}",
            f"07{d(3)} {d(6)}", f"07{d(9)}", f"+447{d(9)}", f"+33 {r.randint(1, 9)} {two}", f"+33{r.randint(1, 9)}{d(8)}", f"0{r.randint(1, 9)} {two}", f"0{r.randint(1, 9)}.{two.replace(' ', '.')}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"+1{d(10)}",
            f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(2, 9)}{d(2)}-{d(3)}-{d(4)}", f"{r.randint(2, 9)}{d(2)} {d(3)} {d(4)}", f"{r.randint(2, 9)}{d(2)} {d(3)}-{d(4)}", f"{r.randint(2, 9)}{d(2)}.{d(3)}.{d(4)}", f"{d(3)}-{d(4)}", f"00{r.choice(['49', '44', '33', '1'])}{d(10)}", f"00{r.choice(['49', '44', '33'])} {d(2)} {d(4)} {d(4)}", f"0044 (0){d(3)} {d(4)} {d(3)}", f"+{r.randint(30, 98)} {d(3)} {d(3)} {d(3)}",
        ]
        return r.choice(kinds)

    def labelled(self) -> tuple[str, str]:
        """(label with a space behind, number)."""
        r, d = self.r, self._d
        A = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        end = r.choice([" ", " ", " ", ": ", " is ", " no. ", " number ", " #", ", "])
        label, value = r.choice([
            (r.choice(["SSN", "Social Security no.", "social security number", "soc. sec."]), f"{d(3)}-{d(2)}-{d(4)}"), (r.choice(["SSN", "social security"]), f"{d(3)} {d(2)} {d(4)}"),
            (r.choice(["NINO", "NI number", "National Insurance", "national insurance no."]), f"{A(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}"), (r.choice(["NINO", "NI no."]), f"{A(2)}{d(6)}{r.choice('ABCD')}"),
            (r.choice(["passport", "Passport", "passport no.", "Passport number"]), f"{A(1)}{d(8)}"), (r.choice(["passport", "Passport no."]), f"{A(2)}{d(7)}"), ("passport", d(9)),
            (r.choice(["tax ID", "TIN", "tax number", "Steuernummer", "tax no."]), f"{d(2)}/{d(3)}/{d(5)}"), (r.choice(["tax ID", "TIN"]), d(11)),
            (r.choice(["licence", "driving licence", "driver's license", "licence no."]), f"{A(5)}{d(6)}{A(2)}{d(1)}{A(1)}"), (r.choice(["licence", "driving licence"]), f"{A(4)}{d(6)}{A(2)}{d(1)}{A(2)}"), ("license", f"{A(1)}{d(3)}-{d(4)}-{d(4)}"),
            (r.choice(["ID card no.", "national ID", "identity card", "ID number", "ID"]), f"{A(2)}{d(7)}"), (r.choice(["national ID", "identity number"]), f"{d(8)}{A(1)}"), (r.choice(["national ID", "ID"]), f"{d(6)}-{d(4)}"),
        ])
        return label + (" " if label.endswith(".") or label.endswith("number") else end), value

    def address(self) -> str:
        r, d = self.r, self._d
        A = lambda: r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        street = (r.choice(STREETS) if r.random() < 0.5 else self._made()) + " " + r.choice(STREET_WORDS)
        no = f"{r.randint(1, 299)}{r.choice(['', '', '', 'a', 'B'])}"
        town = r.choice(TOWNS) if r.random() < 0.5 else self._made() + r.choice(["", "", "burg", "ville", "ton", "dorf"])
        post = r.choice(["", "", f" {d(5)}", f" {A()}{r.choice(['', A()])}{r.randint(1, 20)} {r.randint(1, 9)}{A()}{A()}", f" {A()}{A()}{r.randint(1, 9)} {r.randint(1, 9)}{A()}{A()}"])
        unit = f"{r.choice(['Apt', 'Apt.', 'Unit', 'Suite', 'Flat'])} {r.randint(1, 60)}{r.choice(['', '', 'A', 'B'])}"
        u = r.random()
        if u < 0.12:
            s = f"P.O. Box {d(r.choice([3, 4]))}" if r.random() < 0.7 else f"PO Box {d(4)}"
        elif u < 0.26:
            s = f"{self._made()}{r.choice(['straße', 'strasse', 'weg', 'gasse', 'allee', 'platz'])} {no}"
            return s + (f", {d(5)} {town}" if r.random() < 0.75 else "")
        elif u < 0.38:
            s = f"{no}{r.choice([' ', ', ', ' bis '])}{r.choice(['rue', 'place', 'avenue', 'boulevard', 'chemin', 'impasse'])} {r.choice(['de ', 'du ', 'des ', 'de la ', ''])}{self._made()}"
            return s + (f", {d(5)} {town}" if r.random() < 0.75 else "")
        elif u < 0.48:
            s = f"{unit}, {no} {street}"
        elif u < 0.6:
            s = f"{no} {street}, {unit}"
        elif u < 0.65:
            s = f"{r.choice(HOUSES)}, {no} {street}"
        else:
            s = f"{no}{r.choice([' ', ' ', ' ', ', '])}{street}"
        return s + (f", {town}{post}" if r.random() < 0.78 else "")

    def _fill(self, frame: str) -> tuple[str, Spans]:
        r, out, spans = self.r, "", []
        for bit in re.split(r"(\{\w+\})", frame):
            if not (bit.startswith("{") and bit.endswith("}")):
                out += bit
                continue
            k = bit[1:-1]
            kind = {"n": "NAME", "e": "EMAIL", "p": "PHONE", "i": "ID", "a": "ADDRESS"}.get(k.rstrip("23") if k[0] in "ne" and len(k) < 3 else k)
            if kind:
                if kind == "ID":
                    label, v = self.labelled()
                    out += label
                else:
                    v = {"NAME": self._typed, "EMAIL": self.email, "PHONE": self.phone, "ADDRESS": self.address}[kind]()
                spans.append((len(out), len(out) + len(v), kind))
                out += v
                continue
            made = self._made(3)
            out += {
                "t": lambda: r.choice(["", "", "", "Dr. ", "Dr ", "Prof. ", "Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Mx "]), "noun": lambda: r.choice(NOUNS), "month": lambda: r.choice(MONTHS), "weekday": lambda: r.choice(WEEKDAYS),
                "year": lambda: str(r.randint(1990, 2030)), "date": lambda: r.choice([f"20{self._d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)} {r.choice(MONTHS)} 20{self._d(2)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{self._d(2)}"]),
                "time": lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}", "code": lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(2, 4))), "w": lambda: r.choice(self.words).capitalize(), "w2": lambda: r.choice(self.words), "street": lambda: (r.choice(STREETS) if r.random() < 0.5 else made) + " " + r.choice(STREET_WORDS[:13]), "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(8)), "thing": lambda: made, "handle": lambda: r.choice([made.lower(), "atlas", "router_bot", "here"]),
                "pkg": lambda: made.lower(), "town": lambda: r.choice(TOWNS), "org": lambda: f"{made if r.random() < 0.6 else r.choice(SURNAMES)} {r.choice(ORGS)}{r.choice(['', '', ' Ltd', ' Inc.', ' GmbH'])}",
            }.get(k, lambda: self._d(int(k[1])))()
        return out, spans

    def sentence(self) -> tuple[str, Spans]:
        """A frame filled, a plain sentence, or one with something labelled put into it or a name in the place of a noun phrase."""
        u = self.r.random()
        if u < 0.42:
            return self._fill(self.r.choice(self.frames))
        if u < 0.54:
            return self._fill(self.r.choice(OTHER))
        s = self.r.choice(self.shared if self.shared and u > 0.93 else self.plain)
        if u < 0.67:
            at = [m.end() for m in re.finditer(r"[a-z][,;:]? (?=[a-z])", s)]
            if at:
                x = self.r.choice(at)
                mid, sp = self._fill(self.r.choice(["{n}", "{p}", "{p}", "{e}", "{e}", "{a}", "{a}", "{i}", "({p})", "({e})", "<{e}>", "({i})", "- {p} -", "{n}'s", "{t}{n},"]))
                return f"{s[:x]}{mid} {s[x:]}", [(b + x, e + x, k) for b, e, k in sp]
        elif u < 0.8:
            at = [m for m in re.finditer(r"\b(?:[Tt]he|[Aa]n?|[Oo]ur) [a-z]+(?: [a-z]+)?(?= (?:was|had|has|is|and|in|on|at|for|to|of|because|opened|used|found|kept)\b|[.,;])", s)]
            if at:
                m = self.r.choice(at)
                v = self._typed()
                return s[: m.start()] + v + s[m.end() :], [(m.start(), m.start() + len(v), "NAME")]
        return s, []

    def text(self) -> tuple[str, Spans]:
        """Some sentences in a row, sometimes in lower or upper case."""
        out, spans = "", []
        for _ in range(self.r.randint(1, 4)):
            s, sp = self.sentence()
            if out:
                out += self.r.choice([" ", " ", " ", "\n", "  ", "\n\n"])
            u = self.r.random()
            t = s.lower() if u < 0.07 else s.upper() if u < 0.1 else s
            s = t if len(t) == len(s) else s
            spans += [(a + len(out), b + len(out), k) for a, b, k in sp]
            out += s
        return out, spans


def plain_sentences(texts: list[str]) -> list[str]:
    return sorted({s for t in texts for s in _sentences(t)})


def shared_sentences(texts: list[str], least: int = 20) -> list[str]:
    """Sentences that at least `least` texts have word for word, as notes of a template; with two capitalised words they may hold a name and are left out."""
    n: dict[str, int] = {}
    for t in texts:
        for s in set(_sentences(t)):
            n[s] = n.get(s, 0) + 1
    return sorted(s for s, k in n.items() if k >= least and not re.search(r"[A-ZÀ-Þ][\w'’.-]*,? [A-ZÀ-Þ]", s))


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if 8 < len(s) < 200 and s.isprintable() and not re.search(r"@|\d{5}|\d[ /-]\d{3}", s)]
