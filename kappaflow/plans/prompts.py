"""Prompt templates for the four grading methods (written for this engine).

Holes are ``${name}``; ``fill_template`` replaces ``${rpt}`` last.  The
grading scale (1..5) and the response fields must match the response
schemas in ``kappaflow.schemas``.
"""

SYSTEM = """You grade chest X-ray reports by the follow-up they need.
Scale:
1 = normal, no findings
2 = normal variant or minor finding, no follow-up
3 = abnormal, non-urgent follow-up
4 = abnormal, potentially important finding
5 = critical, urgent follow-up
Use 5 for new life-threatening or life-changing findings (for example pneumothorax,
free air, a misplaced tube or line, a new suspicious lesion, a new fracture).
Answer with valid JSON only, in the format asked for."""

EXTRACT = """Report:
<report>
${rpt}
</report>

List the positive findings, the medical devices (tubes and lines) and the overall diagnoses.
Use only terms from these lists; pick the closest term when unsure.
Findings: ${findings_str}
Devices: ${devices_str}
Diagnoses: ${diagnoses_str}

For each finding give: finding, location, system (Lung, Pleura, Heart, Mediastinum, MSK, Abdomen),
temporal (new, better, worse, stable, not mentioned), uncertainty (certain, uncertain, not mentioned).
For each device give: medical_device, placement (satisfactory, suboptimal, malpositioned, not mentioned).
For each diagnosis give: diagnosis, temporal.
Leave negated findings out; "probably" or "likely" counts as certain, "possibly" or
"cannot be excluded" as uncertain; plural terms are written singular.
Return {"findings_all": [...], "devices_all": [...], "diagnoses_all": [...]}."""

GRADE = """Grade this report on the scale 1 to 5 and return the highest grade of its findings.
A comparison with an earlier study does not change the grade; a finding of unknown age counts as new.

<report>
${rpt}
</report>

Return {"grade": <1-5>}."""

HYBRID = """Grade this report on the scale 1 to 5.  An assistant graded it ${grade_semialgo};
take that grade into account and say why it is or is not appropriate.
Terms to consider: ${findings_str}
Diagnoses to consider: ${diagnoses_str}

<report>
${rpt}
</report>

Return {"grade": <1-5>, "explanation": "<text>"}."""

JUDGE = """Two automatic grades were given to this report: algorithm ${grade_algo}, language model ${grade_llm}.
Give the grade (1 to 5) you find right and say which of the two is better:
0 = neither, 1 = algorithm, 2 = language model, 3 = both the same.

${rpt}

Return {"grade": <1-5>, "choice": <0-3>, "explanation": "<text>"}."""

JUDGE_EXT = """Two grades were given to this report: automatic ${grade_auto}, manual ${grade_manual}.
Give the grade (1 to 5) you find right and say which of the two is better:
0 = neither, 1 = automatic, 2 = manual, 3 = both the same.

${rpt}

Return {"grade": <1-5>, "choice": <0-3>, "explanation": "<text>"}."""

TEMPLATES = {"extract": EXTRACT, "llm": GRADE, "hybrid": HYBRID, "judge": JUDGE, "judge_ext": JUDGE_EXT}
