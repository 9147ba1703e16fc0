"""Task specifications in YAML: who takes part, what each is told, and what each may see."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Spec:
    name: str
    loader: str
    agents: tuple[str, ...]
    system: str
    answer_line: str
    context: str
    personas: dict[str, tuple[str, ...]]
    conditions: dict[str, tuple[str, dict | None]] = field(default_factory=dict)
    disclosure: dict[str, Any] = field(default_factory=lambda: {"mode": "full"})
    loader_args: dict[str, Any] = field(default_factory=dict)
    turn: dict[str, str] = field(default_factory=dict)
    max_words: int = 180
    rounds: int = 3
    notes: str = ""

    def persona(self, condition: str) -> str:
        return self.conditions[condition][0] if condition in self.conditions else condition

    def disclosure_for(self, condition: str) -> dict[str, Any]:
        """The condition's own rule if it has one; else the task's, which by role holds for personas it names and falls back otherwise."""
        own = self.conditions.get(condition, (None, None))[1]
        if own is not None:
            return dict(own)
        if self.disclosure.get("mode") != "role_aligned":
            return dict(self.disclosure)
        named = self.disclosure.get("affinity", {}).get(self.persona(condition))
        return {"mode": self.disclosure.get("fallback", "full")} if named is None else {"mode": "role_aligned", "affinity": named}

    def render(self, question: str, public: str, items: list[str]) -> str:
        """What an agent is shown: the task's frame around the items it was dealt."""
        return self.context.format(question=question, public=public, items="\n\n".join(items)).strip()


def load_spec(path: str | Path) -> Spec:
    """The specification in a file; ValueError names the file and what is wrong with it."""
    import yaml

    path = Path(path)
    data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}

    def need(part: dict, key: str) -> Any:
        if key not in part:
            raise ValueError(f"{path}: {key} is missing")
        return part[key]

    def check(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"{path}: {what}")

    agents = tuple(data.get("agents") or "ABC")
    personas = {name: tuple(prompts) for name, prompts in (need(data, "personas") or {}).items()}
    check(bool(personas), "no persona is defined")
    for name, prompts in personas.items():
        check(len(prompts) == len(agents), f"persona {name} has {len(prompts)} prompts for {len(agents)} agents")
    conditions = {name: ((raw or {}).get("persona", name), (raw or {}).get("disclosure")) for name, raw in (data.get("conditions") or {}).items()}
    for name, (persona, rule) in conditions.items():
        check(persona in personas, f"condition {name} names the unknown persona {persona}")
        check(rule is None or isinstance(rule, dict), f"the disclosure of condition {name} is no mapping")
    disclosure = data.get("disclosure") or {"mode": "full"}
    if disclosure.get("mode") == "role_aligned":
        named = disclosure.get("affinity")
        check(isinstance(named, dict) and set(named) <= set(personas), "a disclosure by role needs an affinity for personas of the task")
    task = need(data, "task")
    return Spec(
        name=data.get("name") or path.stem, loader=need(data, "loader"), loader_args=data.get("loader_args") or {}, agents=agents, personas=personas, conditions=conditions, disclosure=disclosure,
        system=need(task, "system"), answer_line=need(task, "answer_line"), context=need(task, "context"), turn=task.get("turn") or {}, max_words=int(task.get("max_words", 180)),
        rounds=int(data.get("rounds", 3)), notes=data.get("notes", ""),
    )
