"""Fixed values of the log format and of the game catalogue.

They have to equal the published ones for results to match, so they are stated
here as plain text, together and in natural order.
"""

# Effect categories (fifth slot, before the colon).
CATEGORY_EVENT = "836045448945472"
CATEGORY_SPEND = "836045448945473"
CATEGORY_RESTORE = "836045448945476"
CATEGORY_APPLY_EFFECT = "836045448945477"
CATEGORY_REMOVE_EFFECT = "836045448945478"
CATEGORY_AREA_ENTERED = "836045448953664"
CATEGORY_DISCIPLINE_CHANGED = "836045448953665"
CATEGORY_MODIFY_CHARGES = "836045448953666"

# Event subtypes.
EVENT_ABILITY_ACTIVATE = "836045448945479"
EVENT_ABILITY_DEACTIVATE = "836045448945480"
EVENT_ABILITY_CANCEL = "836045448945481"
EVENT_ABILITY_INTERRUPT = "836045448945482"
EVENT_MODIFY_THREAT = "836045448945483"
EVENT_FALLING_DAMAGE = "836045448945484"
EVENT_TAUNT = "836045448945488"
EVENT_ENTER_COMBAT = "836045448945489"
EVENT_EXIT_COMBAT = "836045448945490"
EVENT_DEATH = "836045448945493"
EVENT_REVIVED = "836045448945494"
EVENT_TARGET_SET = "836045448953668"
EVENT_TARGET_CLEARED = "836045448953669"

# Effects with a meaning of their own.
EFFECT_HEAL = "836045448945500"
EFFECT_DAMAGE = "836045448945501"
EFFECT_ABSORBED = "836045448945511"
EFFECT_REFLECTED = "836045448953649"

# Damage types and avoidance kinds by id.
DAMAGE_TYPES = {
    "836045448940873": "kinetic",
    "836045448940874": "energy",
    "836045448940875": "elemental",
    "836045448940876": "internal",
}
MITIGATION_KINDS = {
    "836045448945502": "miss",
    "836045448945503": "parry",
    "836045448945505": "dodge",
    "836045448945506": "immune",
    "836045448945507": "resist",
    "836045448945508": "deflect",
    "836045448945509": "shield",
}

GROUP_SIZES = (4, 8, 16)
DIFFICULTIES = ("Story", "Veteran", "Master")

# Words that link a non-kill victory text to a logged event.
VICTORY_MARKERS = (
    "puzzle", "solv", "align", "core", "vanquish", "retreat", "teleport", "terminal", "destroy",
)
BOSS_DEFEAT_TEXT = "boss defeated|both bosses defeated|all .* defeated"

# Discipline, role, combat style.
DISCIPLINES = """
Defense|tank|Jedi Guardian
Vigilance|dps|Jedi Guardian
Focus|dps|Jedi Guardian
Immortal|tank|Sith Juggernaut
Vengeance|dps|Sith Juggernaut
Rage|dps|Sith Juggernaut
Watchman|dps|Jedi Sentinel
Combat|dps|Jedi Sentinel
Concentration|dps|Jedi Sentinel
Annihilation|dps|Sith Marauder
Carnage|dps|Sith Marauder
Fury|dps|Sith Marauder
Kinetic Combat|tank|Jedi Shadow
Infiltration|dps|Jedi Shadow
Serenity|dps|Jedi Shadow
Darkness|tank|Sith Assassin
Deception|dps|Sith Assassin
Hatred|dps|Sith Assassin
Seer|healer|Jedi Sage
Telekinetics|dps|Jedi Sage
Balance|dps|Jedi Sage
Corruption|healer|Sith Sorcerer
Lightning|dps|Sith Sorcerer
Madness|dps|Sith Sorcerer
Combat Medic|healer|Commando
Gunnery|dps|Commando
Assault Specialist|dps|Commando
Bodyguard|healer|Mercenary
Arsenal|dps|Mercenary
Innovative Ordnance|dps|Mercenary
Shield Specialist|tank|Vanguard
Tactics|dps|Vanguard
Plasmatech|dps|Vanguard
Shield Tech|tank|Powertech
Advanced Prototype|dps|Powertech
Pyrotech|dps|Powertech
Sawbones|healer|Scoundrel
Scrapper|dps|Scoundrel
Ruffian|dps|Scoundrel
Medicine|healer|Operative
Concealment|dps|Operative
Lethality|dps|Operative
Sharpshooter|dps|Gunslinger
Saboteur|dps|Gunslinger
Dirty Fighting|dps|Gunslinger
Marksmanship|dps|Sniper
Engineering|dps|Sniper
Virulence|dps|Sniper
"""

# Defensive effects surfaced by a death audit (name, effect id, category).
DEFENSIVES = """
Saber Ward|807793154064384|self
Force Barrier|3120895035965440|self
Warding Call|812483258351616|self
Enure|2211126473392128|self
Blade Turning|2312058204848128|self
Deflection|812719481552896|self
Resilience|812822560768000|self
Reactive Shield|801329228284194|self
Energy Shield|3067551542149120|self
Shield Probe|3144233888252165|absorb
Evasion|2816081206968320|self
Endure Pain|2211074933784576|self
Guarded by the Force|2528571801206784|self
Rebuke|2480816059842560|self
Saber Reflect|3126160665870336|reflect
Sonic Rebounder|801354998088314|reflect
Force Camouflage|3488183459250176|self
Diversion|801273393709056|self
Blade Blitz|3618351033090048|self
Mad Dash|3602532668538880|self
Phase Walk|3200416355450880|self
Adrenaline Rush|801251918872576|self
Battle Readiness|979849543942144|self
Focused Defense|2793700132388864|self
Blazing Ward|3466347845517312|absorb
Warding Shield|4661839107457304|absorb
Guard|1775934617157632|external
Taunt|801316343382296|threat
Force Shroud||self
Undying Rage||self
Cloak of Pain||self
Invincible||self
Entrench||self
Hunker Down||self
Kolto Overload||self
Overcharge Saber||self
"""


def table(text: str) -> list[list[str | None]]:
    """Rows of one of the pipe-separated blocks above."""
    return [[cell or None for cell in line.split("|")] for line in text.strip().splitlines()]
