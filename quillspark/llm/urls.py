"""URL filter: rules by host suffix and path prefix, else logistic regression on hashed n-grams.

A URL's host is what lies between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-
cased; its path goes on to `?`, `#` or the end.  A rule (host, path, verdict) fits its host and all
subdomains where the path starts with the rule's; the longest fitting rule wins, of equally long ones
the first by its text.  All other URLs get the classifier's verdict.

The labelled table of this module is small and general: hosts and paths of gambling, drug, adult,
advertising, link-selling and fraud sites against those of ordinary ones, in four languages.

The classifier counts character n-grams of `^host$` and of `^path$` in hashed buckets and is trained
on a labelled URL table, at most `max_rows` of it, chosen by a hash of the URL.

Defined results: a null URL, or one without `://`, has an empty host and path and gets the verdict on
these; repeated rows are judged alike; an empty labelled table gives a classifier that allows all;
other columns are never read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns

BUCKETS = 1 << 16
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: A small labelled URL table, made up for this purpose; its hosts stand in no test table.
BLOCKED_URLS = """
https://royal-roulette.com/slots/bonus/signup
https://www.pokerjackpot.net/en/tables?ref=77
http://mega-slots777.org/jackpot
https://bet-on-sport24.com/odds/today
https://gambling-kings.info/poker/rooms
https://play.bingo-millions.net/lobby
http://sportwetten-bonus.com/anmelden
https://apuestas-seguras.net/ruleta/gratis
https://paris-sportifs-bonus.org/inscription
https://luckyspins.info/roulette/live
https://vip-blackjack.com/deposit/bonus
http://slotmachine-jackpots.net/spin
https://www.betting-tips-vip.org/odds/sure
https://baccarat-online.info/play/now
https://lottery-millions.com/jackpot/claim
http://onlinewetten.org/bonus/code
https://poker-deposit-bonus.net/signup
https://buy-viagra-online.com/order/now
https://discount-pharmacy.net/cialis/100mg
http://rx-meds-overnight.org/tramadol
https://www.canadian-pharmacy.info/viagra/buy
https://no-prescription-drugs.com/xanax/order
https://weightloss-tablets.net/order?discount=70
http://generic-viagra.org/cialis/price
https://potenzmittel-kaufen.com/viagra/rezeptfrei
https://pharmacie-sans-ordonnance.net/cialis
https://farmacia-sin-receta.info/viagra/comprar
https://steroids-shop.com/buy/anabolic
http://miracle-diet-meds.net/lose-weight-fast
https://sleeping-tablets-online.org/buy/xanax
https://xxx-videos-hd.com/porn/amateur
https://porn-tube.net/watch/sex
http://www.sexcams-live.org/girls/nude
https://hotmilf.info/porn/videos
https://nude-teens18.com/gallery/xxx
https://escort-girls.net/city/erotic
https://livesex-chat.org/cams/nude
https://sexkontakte.com/erotik/chat
https://videos-porno.net/gratuit/sexe
http://erotik-portal.info/porno/filme
https://pornostar.org/xxx/scene
https://camgirls.com/nude/live
https://hentai-xxx.net/sex/comics
https://fetish-porn.info/watch
https://adserver-click.com/banner/redirect?id=9
https://popunder-network.net/click/redirect
http://click.banner-exchange.org/redirect?to=shop
https://affiliate-clicks.info/campaign/redirect
https://pixel.advertising-server.com/impression
https://banner-rotator.net/adclick/view
https://popup-advert.org/clickserver/campaign
http://trk.clickbank-offers.com/redirect/campaign
https://advert-popups.info/banner/impression
https://push-notification-service.com/subscribe/click
https://seo-backlinks.com/buy/links/bulk
http://linkfarming.net/directory/submit/links
https://article-spinner.org/generate/bulk
https://buy-followers.info/instagram/likes
https://bulk-mailer.com/email/lists/buy
https://guestbook-poster.net/submit/links
http://doorway-pages.org/keywords/bulk
https://instant-traffic.info/visitors/buy
https://fake-reviews.com/buy/stars
https://secure-login-paypal.com/verify/account
http://account-verify-bank.net/login/confirm
https://appleid-unlock.org/verify/password
https://update-your-bank.info/login/secure
https://amazon-prize-claim.com/verify/winner
https://crypto-doubler.net/send/bitcoin
http://bitcoin-giveaway.org/claim/wallet
https://wallet-recovery.info/seed/verify
https://payday-loan-instant.com/apply/cash
https://quick-cash-loans.net/apply/nocredit
http://kredit-ohne-schufa.org/sofort/antrag
https://earn-money-fast.info/cash/signup
https://replica-watches.com/rolex/buy
http://designer-handbags-replica.net/gucci/discount
https://luxury-replica.org/rolex/sale
https://cracked-software.info/keygen/serial
https://warez-download.com/crack/full
http://movie-torrents.net/download/cracked
https://serial-keys.org/keygen/activation
https://hacked-accounts.com/netflix/buy
https://fake-passport.net/order/documents
""".split()
ALLOWED_URLS = """
https://www.city-library.org/catalogue/search?q=history
https://news.daily-courier.com/2021/03/local/council
https://mathematics-notes.net/algebra/groups.html
https://www.river-museum.org/visit/opening-hours
http://gardening-club.info/tips/roses
https://blog.slow-cooking.com/recipes/lentil-soup
https://docs.compiler-tools.org/manual/linking
https://university-press.net/journals/physics
https://weather-office.org/forecast/week
https://schoolboard.info/meetings/minutes
https://www.hill-walking.com/routes/lakes
https://birdwatchers.org/species/finch
https://opendata.region-west.net/transport/stops
https://archive.folk-songs.org/lyrics/winter
https://www.medieval-history.net/castles/wales
https://astronomy-evenings.com/planets/saturn
https://www.hospital-trust.org/departments/cardiology
https://railway-timetable.net/stations/north
https://chess-problems.info/studies/endgame
https://language-exchange.org/lessons/grammar
https://stadtbibliothek-nord.net/oeffnungszeiten
https://www.wanderverein.org/touren/alpen
https://zeitung-am-sonntag.com/politik/artikel/8812
https://kochrezepte-heute.info/suppen/kartoffel
https://universitaet-west.org/forschung/chemie
https://musikschule.net/kurse/klavier
https://gemeinde-seedorf.info/rathaus/termine
https://museum-der-stadt.com/ausstellung/malerei
https://bibliotheque-centrale.org/catalogue/romans
https://journal-du-matin.com/culture/article/2210
https://www.randonnees.net/sentiers/montagne
https://recettes-familiales.info/desserts/tarte
https://universite-sud.org/recherche/biologie
https://mairie-valmont.net/conseil/reunions
https://musee-des-arts.com/expositions/peinture
https://ecole-de-musique.info/cours/violon
https://biblioteca-publica.org/libros/novela
https://diario-regional.com/politica/noticia/5521
https://senderos-del-norte.net/rutas/costa
https://cocina-casera.info/sopas/verduras
https://universidad-este.org/investigacion/fisica
https://ayuntamiento-lago.net/pleno/actas
https://museo-de-arte.com/exposicion/pintura
https://escuela-de-idiomas.info/cursos/frances
https://www.linux-kernel-notes.org/memory/paging
https://python-handbook.net/tutorial/lists
https://data-structures.info/trees/balanced
https://statistics-course.org/lectures/regression
https://www.parliament-records.net/debates/1998
https://court-decisions.org/appeal/2004
https://volunteer-fire.com/stations/contact
https://allotment-society.org/plots/waiting-list
https://www.theatre-royal.net/programme/autumn
https://orchestra-hall.com/concerts/season
https://poetry-review.org/issues/spring
https://cycling-routes.info/maps/coast
https://swimming-club.net/training/times
https://sailing-school.org/courses/beginners
https://knitting-patterns.com/scarves/wool
https://woodwork-shed.net/projects/bench
https://beekeeping.info/hives/winter
https://geology-field.org/rocks/granite
https://botanic-garden.net/plants/ferns
https://zoology-dept.org/staff/research
https://marine-station.info/tides/table
https://climate-records.org/temperature/monthly
https://energy-advice.net/insulation/loft
https://recycling-centre.info/opening/hours
https://housing-office.org/tenants/forms
https://bus-company.net/timetables/route-12
https://airport-guide.info/terminals/north
https://translation-notes.org/dictionary/latin
https://philosophy-papers.net/ethics/kant
https://economics-review.com/issues/trade
https://children-books.org/authors/stories
https://teacher-resources.net/science/worksheets
https://www.parents-forum.info/topics/sleep
https://dog-training.org/puppies/basics
https://horse-riding.net/stables/lessons
https://photo-society.com/exhibition/landscape
https://radio-amateurs.org/frequencies/licence
https://model-railways.info/layouts/gauge
https://village-hall.net/events/market
https://choir-singers.org/rehearsals/tuesday
https://local-elections.info/results/2019
https://www.consumer-advice.org/contracts/rights
https://patient-leaflets.net/asthma/children
https://nursing-college.org/admissions/dates
https://engineering-institute.net/standards/bridges
https://chemistry-lab.info/safety/solvents
https://genome-browser.org/chromosome/seven
https://space-agency.net/missions/probe
https://physics-lectures.org/quantum/notes
https://map-archive.info/sheets/1890
https://census-office.net/population/tables
https://encyclopedia-online.org/article/volcano
https://dictionary-project.net/entry/harvest
https://letters-archive.org/1862/correspondence
https://press-agency.net/en/story/44710
https://www.press-agency.net/de/meldung/44711
https://standards-body.org/en/documents/9001
https://forum.sound-engineers.com/thread/60213
https://blog.harbour-town.info/2017/05/18
https://m.evening-post.com/article/7730215
https://sports-results.org/season/2011/match/314
https://patents-register.org/publication/1093345
https://m.film-archive.net/es/ficha/2087
https://weather-station.info/fr/bulletin/365
https://recipes.country-kitchen.org/page/12
https://www.standards-body.org/es/documentos/27001
""".split()
HELD_OUT_MOD = 5


def labelled_urls() -> list[tuple[str, int]]:
    """(url, label; 1: block)."""
    return [(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS]


def held_out(url: str) -> bool:
    """Whether a labelled URL is kept from the fit, to measure it: a fifth of them, by a hash."""
    return zlib.crc32(url.encode()) % HELD_OUT_MOD == 0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), *_LETTERS)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.translate(str.maketrans(*_LETTERS)), slash + path


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The winning rule's text and verdict, null where none fits.  A few rules: one CASE each."""
    text = verdict = F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # later ones take precedence
        h, p = split_rule(rule)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def ngrams(host: str, path: str, sizes=(3, 4)) -> Counter:
    """Bucket -> count of the character n-grams of host and path."""
    out: Counter = Counter()
    for tag, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            for i in range(len(s) - n + 1):
                out[zlib.crc32((tag + s[i : i + n]).encode("utf-8", "surrogatepass")) % BUCKETS] += 1
    return out


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, host: str, path: str) -> float:
        grams = ngrams(host, path)
        if not grams:
            return self.intercept
        at = np.fromiter(sorted(grams), np.int64)
        x = np.log1p(np.array([grams[k] for k in at.tolist()], np.float64))
        return float(self.weights[at] @ (x / np.sqrt(x @ x)) + self.intercept)


def fit(labelled: DataFrame, url: str = "url", label: str = "label", max_rows: int = 20_000, l2: float = 1e-4, steps: int = 300, rate: float = 8.0) -> Model:
    """Full-batch gradient descent over at most max_rows labelled URLs."""
    known = labelled.where(F.col(label).isin(0, 1))
    rows = known.select(host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"), F.col(label).cast("int").alias("y"), F.xxhash64(url).alias("k")).orderBy("k", "h", "p", "y").limit(max_rows).collect()
    w = np.zeros(BUCKETS)
    if not rows:
        return Model(w, -1.0)
    at, x, head = [], [], [0]
    for r in rows:
        grams = ngrams(r["h"], r["p"])
        keys = sorted(grams)
        v = np.log1p(np.array([grams[k] for k in keys], np.float64))
        at += keys
        x += (v / max(1e-9, np.sqrt(v @ v))).tolist()
        head.append(len(at))
    at, x, y = np.array(at, np.int64), np.array(x), np.array([r["y"] for r in rows], np.float64)
    row = np.repeat(np.arange(len(rows)), np.diff(head))
    intercept = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[at] * x, minlength=len(rows)) + intercept, -30, 30)))
        g = (p - y) / len(rows)
        w -= rate * (np.bincount(at, weights=g[row] * x, minlength=BUCKETS) + l2 * w)
        intercept -= rate * 0.1 * g.sum()
    return Model(w, intercept)


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict ("allow" or "block"), score (the classifier's log odds)."""
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches):
        for rows in batches:
            scores = [model.score(h, p) for h, p in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())]
            yield with_columns(rows, ["page_id", "host", "path"], score=pa.array(scores, pa.float64()))

    parts = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = parts.mapInArrow(run, f"page_id {kind}, host string, path string, score double")
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select(F.col("page_id").alias(page_id), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
