"""Explicit schemas of the landed feeds."""

PLAYER = "struct<id: long, name: string, shortName: string, position: string>"
INCIDENT = (
    "struct<incidentType: string, incidentClass: string, time: int, addedTime: int, isHome: boolean, homeScore: int, awayScore: int, "
    f"player: {PLAYER}, playerIn: {PLAYER}, playerOut: {PLAYER}, text: string, rescinded: boolean>"
)
LINEUP_ENTRY = f"struct<player: {PLAYER}, jerseyNumber: string, position: string, type: string, reason: string, statistics: map<string, double>>"
LINEUP_SIDE = f"struct<team: struct<name: string>, players: array<{LINEUP_ENTRY}>, substitutes: array<{LINEUP_ENTRY}>, bench: array<{LINEUP_ENTRY}>, missingPlayers: array<{LINEUP_ENTRY}>>"
PERIOD = "struct<period: string, groups: array<struct<statisticsItems: array<struct<name: string, home: string, away: string>>>>>"
MARKET = "struct<marketGroup: string, marketName: string, isLive: boolean, choices: array<struct<name: string, fractionalValue: string>>>"
TRANSFER = (
    "struct<transferSource: struct<clubId: string>, transferDestination: struct<clubId: string>, typeDetails: struct<type: string>, "
    "details: struct<date: string, season: struct<display: string>, age: int, fee: struct<value: double>, marketValue: struct<value: double>>>"
)
TEAM = "struct<id: long, name: string>"
EVENT = f"struct<id: long, homeTeam: {TEAM}, awayTeam: {TEAM}, startTimestamp: long, status: struct<type: string>, homeScore: struct<current: int>, awayScore: struct<current: int>, roundInfo: struct<round: int>>"
SQUAD_ENTRY = "struct<player: struct<id: long, name: string, position: string, positionObject: struct<name: string>>, id: long, name: string, position: string, jerseyNumber: string>"
GRAPH_POINT = "struct<minute: double, value: double>"
