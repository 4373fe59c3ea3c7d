"""Aliases and noise words that the normaliser knows by default; mining can make others."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# Vocabulary and patterns that results depend on.
NAME_ALIAS = {"company": "co", "corporation": "corp", "incorporated": "inc", "ltd": "limited"}

ADDRESS_ALIAS = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "ave": "avenue", "blvd": "boulevard", "bombay": "mumbai", "br": "bihar",
    "california": "ca", "cir": "circle", "colorado": "co", "ct": "court", "cv": "cove", "delaware": "de", "dl": "delhi", "door": "plot",
    "dr": "drive", "e": "east", "gj": "gujarat", "howrah": "kolkata", "hr": "haryana", "hwy": "highway", "illinois": "il", "indiana": "in",
    "iowa": "ia", "ka": "karnataka", "kansas": "ks", "kentucky": "ky", "kl": "kerala", "ln": "lane", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "mh": "maharashtra", "minnesota": "mn", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "odisha": "orissa", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pb": "punjab", "pennsylvania": "pa", "pkwy": "parkway", "pl": "place",
    "pradesha": "pradesh", "rd": "road", "rj": "rajasthan", "st": "street", "tennessee": "tn", "ter": "terrace", "texas": "tx",
    "tg": "telangana", "trl": "trail", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
}

ADDRESS_NOISE = (
    "andhra andhrapradesh ap apartment apt bengal bihara borough box brookhaven carolina cdp connecticut dakota dc dilli fl ga gujarata "
    "hariyana hn keralam keralan lot mexico mp nadu nc nd nm ny od pajaba pashchimabanga pmb rajasthana region sc ste suite tamil tamilnatu "
    "unit up uttar uttara wb wv york"
).split()

NAME_NOISE = (
    "aiti aka al as association bijanesa bildarsa blu board business care cea center centre co com commission corp council dba devalaparsa "
    "doing dr egro eksaportsa elaelapi enarji entarapraijeja enterprises esteta federation fka formerly foundation globa globala hai "
    "helthakeyara hr hspitailiti id impeksa inc indastrija injiniyaringa inphoteka inphra inphrastrakchara intaraneshanala invest investamenta "
    "investamentsa jai jay jaya kansaltensi kansaltentsa kansaltinga kanstrakshana kanstrakshansa keyara known la labs lakshmi le li limatida "
    "limirrad limited limiteda limitet ljistiksa llc llp lnc lp mainejamenta marketinga md midiya mr nee nyu on one partners pavara pc "
    "phainensa phaundeshana phuda phudsa piraivet pra praibhet praibheta praivarr praivet praiveta private prodaktsa prodyusara projektsa "
    "prpartija pvt sarviseja service services seva shiva shri sistamsa siti skai slyushansa smt society solution sphtaveyara sri ss sys "
    "system teka teknolji teknoljija the trading tredinga trust vencharsa venture www"
).split()

NULL_WORDS = ("null", "none", "nan", "na", "unknown")
TOP_LEVEL_DOMAINS = ("com", "net", "org", "co", "io", "biz", "info", "in", "us", "fr", "edu", "gov")
ORDINAL_SUFFIXES = ("st", "nd", "rd", "th")
ORDINAL_WORDS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10"}


@dataclass(frozen=True)
class Vocabulary:
    name_alias: dict[str, str] = field(default_factory=lambda: dict(NAME_ALIAS))
    address_alias: dict[str, str] = field(default_factory=lambda: dict(ADDRESS_ALIAS))
    name_noise: tuple[str, ...] = tuple(NAME_NOISE)
    address_noise: tuple[str, ...] = tuple(ADDRESS_NOISE)

    def to_json(self) -> str:
        return json.dumps(self.__dict__, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str | None) -> Vocabulary:
        """Parts that the text doesn't hold keep their defaults."""
        own = json.loads(text) if text else {}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})
