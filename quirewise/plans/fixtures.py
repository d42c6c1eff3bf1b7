"""Sentences that meet each flag, and others that nearly do, as a small table beside the data; they show every rule in both engines."""

from __future__ import annotations

#: For each flag a sentence that meets it and one that nearly does.
FLAGS: dict[str, tuple[str, str]] = {
    "marginal": ("The effect was marginally significant in study two.", "A marginal note, in small print, was significant."),
    "coi": ("The authors declare no conflict of interest.", "A financial disclosure form was mailed to patients."),
    "funding": ("This work was supported by a grant of the regional council.", "This study received no funding support."),
    "data_sentence": ("All data are available in an online repository.", "The data were skewed to the left."),
    "data_request": ("The datasets are available upon reasonable request.", "The database is available on request."),
    "prereg": ("The study was preregistered before collection.", "The study was not preregistered before collection."),
    "prereg_mention": ("We refer to the pre-registration of the trial.", "The register was kept by hand."),
    "causal": ("Sleep loss leads to slower responses.", "Sleep loss precedes slower responses."),
    "design_marker": ("Participants were randomly assigned to two groups.", "Participants were chosen at random from a list."),
    "scale": ("Mood was rated with two subscales.", "The scaled values were plotted."),
    "reliability": ("Cronbach's alpha was .81 for this measure.", "The results were consistent over time."),
    "ethics": ("The protocol was approved by the local university ethics board.", "The plan was approved by the department head."),
    "age": ("The mean age was 24 years.", "The average score was 24 points."),
    "gender": ("In all, 52% were female and the rest male.", "The remaining persons were students."),
    "origin": ("Students were recruited from two schools.", "Staff were hired in spring."),
    "multiplicity": ("We applied a Bonferroni adjustment throughout.", "We adjusted the lamp for each trial."),
    "exclusion": ("Four persons were excluded.", "The rule is exclusive to adults."),
    "exclusion_reason": ("Four persons were excluded because they failed to respond.", "Four persons were excluded."),
    "likert": ("Items used a 7-point Likert format.", "Items were worth seven points."),
    "parametric": ("We ran an independent samples t-test and an ANOVA.", "We ran a sign test."),
    "ordinal_reason": ("A Mann-Whitney test was used in its place.", "A man from Whitney took the test."),
    "coding": ("Answers were coded by two students.", "The code was written in one week."),
    "agreement": ("Cohen's kappa was high.", "Both raters said yes."),
    "confirmatory": ("As predicted, recall declined.", "The forecast predicted rain."),
    "survey": ("An annual survey was sent out.", "The questionnaire items were read aloud."),
    "response_rate": ("The response rate reached 61%.", "The respiration rate reached 61."),
    "panel": ("Workers came from MTurk.", "The panel discussed the results."),
    "panel_quality": ("Two attention checks were embedded.", "Attention was measured twice."),
    "missing": ("Missing data were rare.", "The missing link was found."),
    "missing_handled": ("We relied on multiple imputation.", "We imputed the motive to the speaker."),
    "r_ethics": ("Written consent was obtained.", "Everyone agreed in the end."),
    "r_credit": ("Author contributions: A wrote it.", "The author contributed a chapter."),
    "r_coi": ("We have no competing interests.", "Two companies were competing."),
    "r_funding": ("Funding came from abroad.", "The fund was closed."),
    "r_prereg": ("See osf.io for the plan.", "The register is closed."),
    "r_protocol": ("The study protocol is attached.", "The analysis plan was short."),
    "r_materials": ("All materials are available online.", "The material was soft."),
    "r_data": ("Data are available from the archive.", "The data of both waves."),
    "r_code": ("Code is shared in a replication package.", "The coded answers."),
    "r_preprint": ("A preprint was posted earlier.", "The printed version."),
    "r_model": ("A large language model checked the grammar.", "A large model of a bridge."),
    "r_impact": ("The social impact is discussed below.", "The impact of social ties."),
}
#: Sentences with reported statistics, one for each outcome of the checks.
STATISTICS = [
    "The test was clear, t(98) = 2.50, p = .014, d = 0.50, n1 = 50, n2 = 50, 95% CI [0.10, 0.90].",
    "The test was off, t(98) = 2.50, p = .214, d = 0.90, n1 = 50, n2 = 50.",
    "Sizes are not named, t(98) = 2.50, p < .05, d = 0.50.",
    "Paired scores, t(39) = 3.00, p = .005, dz = 0.47, n = 40.",
    "A correlation, t(48) = 2.10, p = .041, r = .29, n = 50, 95% CI [0.01, 0.53].",
    "A correlation with another interval, r = .29, n = 50, 95% CI [0.19, 0.39].",
    "Groups differed, F(2, 57) = 4.10, p = .022, η2 = .13.",
    "Groups differed, F(2, 57) = 4.10, p = .022, η2 = .21.",
    "A slight slip, F(2, 57) = 4.10, p = .022, η2 = .155.",
    "No group differed, F(1, 2500) = 3.00, p = .083.",
    "A sign gone wrong, F(2, 57) = -4.10, p = .022.",
    "Roughly, t(30) = 2.04, p ~ .05.",
    "Counts differed, χ2(1) = 6.40, p = .011, phi = .25, N = 100.",
    "Counts differed, χ2(3) = 6.40, p = .094, V = .15, N = 100, m = 3.",
    "Counts differed, χ2(3) = 6.40, p = .094, V = .15, N = 100.",
    "A reversed interval, d = 0.30, 95% CI [0.60, 0.00].",
    "A number too long, t(99999999999) = 2.10, p = .04.",
    "Nothing was found, t(20) = 0.40, p > .05, and p = n.s. in the other group.",
    "Ratings (M = 3.45, SD = 0.50, n = 20) and others (M = 3.44, SD = 9.10, n = 21) were taken.",
    "",
]
LINKS = ["Files are at https://github.com/lab/repo.", "The plan is at https://osf.io/ab123/ and https://aspredicted.org/xy12.pdf.", "See zenodo.org/record/77, or www.example.org/a).", "Write to someone@example.com about it."]
