"""What the rules make of the sentences of parsed_fixtures: taken from a run and then checked by hand, line by line.

One line per variant: sentence, rule, subtype, net negation, scope, variant. Rules that only put one of a list of words in
(adverbs, hedges, intensifiers, triggers) are stated for four sentences.
"""

TEMPLATES = ['hedge_wrap_v1', 'implicit_trigger_v1', 'intensify_wrap_v1', 'k1_trigger_cancel_v1', 'negadv_insert_v1']
TEMPLATE_SENTENCES = ["0", "6", "9", "11"]

VARIANTS = """\
0	syn_do_support_v1	do_support	1	clause	The function does not sort the array.
0	negadv_insert_v1	absolute	1	clause	The function never sorts the array.
0	negadv_insert_v1	partial	1	clause	The function hardly sorts the array.
0	negadv_insert_v1	partial	1	clause	The function barely sorts the array.
0	negadv_insert_v1	partial	1	clause	The function rarely sorts the array.
0	negadv_insert_v1	partial	1	clause	The function seldom sorts the array.
0	negadv_insert_v1	partial	1	clause	The function scarcely sorts the array.
0	implicit_trigger_v1	fails_to	1	clause	The function fails to sort the array.
0	implicit_trigger_v1	refuses_to	1	clause	The function refuses to sort the array.
0	implicit_trigger_v1	neglects_to	1	clause	The function neglects to sort the array.
0	implicit_trigger_v1	ceases_to	1	clause	The function ceases to sort the array.
0	implicit_trigger_v1	is_unable_to	1	clause	The function is unable to sort the array.
0	implicit_trigger_v1	denies	1	clause	The function denies sorting the array.
0	hedge_wrap_v1	maybe_not	1	clause	The function maybe does not sort the array.
0	hedge_wrap_v1	possibly_not	1	clause	The function possibly does not sort the array.
0	hedge_wrap_v1	probably_not	1	clause	The function probably does not sort the array.
0	hedge_wrap_v1	might_not	1	clause	The function might not sort the array.
0	hedge_wrap_v1	may_not	1	clause	The function may not sort the array.
0	intensify_wrap_v1	surely_not	1	clause	The function surely does not sort the array.
0	intensify_wrap_v1	definitely_not	1	clause	The function definitely does not sort the array.
0	intensify_wrap_v1	certainly_not	1	clause	The function certainly does not sort the array.
0	intensify_wrap_v1	absolutely_not	1	clause	The function absolutely does not sort the array.
0	k1_trigger_cancel_v1	never_fails_to	0	clause	The function never fails to sort the array.
0	k1_trigger_cancel_v1	never_refuses_to	0	clause	The function never refuses to sort the array.
0	k1_trigger_cancel_v1	never_neglects_to	0	clause	The function never neglects to sort the array.
0	k1_trigger_cancel_v1	never_ceases_to	0	clause	The function never ceases to sort the array.
1	syn_do_support_v1	do_support	1	clause	The function did not sort the array.
2	syn_do_support_v1	do_support	1	clause	The functions do not sort the array.
3	syn_do_support_v1	do_support	1	clause	I do not sort the array.
4	syn_do_support_v1	do_support	1	clause	They did not solve the problem.
5	syn_do_support_v1	do_support	1	clause	The parser did not go wrong.
6	syn_do_support_v1	do_support	1	clause	Do not sort the array.
6	negadv_insert_v1	absolute	1	clause	Never sort the array.
6	negadv_insert_v1	partial	1	clause	Hardly sort the array.
6	negadv_insert_v1	partial	1	clause	Barely sort the array.
6	negadv_insert_v1	partial	1	clause	Rarely sort the array.
6	negadv_insert_v1	partial	1	clause	Seldom sort the array.
6	negadv_insert_v1	partial	1	clause	Scarcely sort the array.
6	implicit_trigger_v1	fails_to	1	clause	Fail to sort the array.
6	implicit_trigger_v1	refuses_to	1	clause	Refuse to sort the array.
6	implicit_trigger_v1	neglects_to	1	clause	Neglect to sort the array.
6	implicit_trigger_v1	ceases_to	1	clause	Cease to sort the array.
6	implicit_trigger_v1	denies	1	clause	Deny sorting the array.
6	hedge_wrap_v1	maybe_not	1	clause	Maybe do not sort the array.
6	hedge_wrap_v1	possibly_not	1	clause	Possibly do not sort the array.
6	hedge_wrap_v1	probably_not	1	clause	Probably do not sort the array.
6	hedge_wrap_v1	might_not	1	clause	Might not sort the array.
6	hedge_wrap_v1	may_not	1	clause	May not sort the array.
6	intensify_wrap_v1	surely_not	1	clause	Surely do not sort the array.
6	intensify_wrap_v1	definitely_not	1	clause	Definitely do not sort the array.
6	intensify_wrap_v1	certainly_not	1	clause	Certainly do not sort the array.
6	intensify_wrap_v1	absolutely_not	1	clause	Absolutely do not sort the array.
6	k1_trigger_cancel_v1	never_fails_to	0	clause	Never fail to sort the array.
6	k1_trigger_cancel_v1	never_refuses_to	0	clause	Never refuse to sort the array.
6	k1_trigger_cancel_v1	never_neglects_to	0	clause	Never neglect to sort the array.
6	k1_trigger_cancel_v1	never_ceases_to	0	clause	Never cease to sort the array.
6	imperative_contracted_v1	imperative_contracted	1	clause	Don't sort the array.
7	syn_do_support_v1	do_support	1	clause	He does not always arrive early.
7	quant_swap_v1	always_to_never	1	predicate	He never arrives early.
7	antonym_wordnet_v1	antonym_adv	1	predicate	He always arrives late.
8	syn_existing_aux_v1	existing_aux	1	clause	She has not finished the report.
9	syn_existing_aux_v1	existing_aux	1	clause	The model cannot handle noise.
9	negadv_insert_v1	absolute	1	clause	The model can never handle noise.
9	negadv_insert_v1	partial	1	clause	The model can hardly handle noise.
9	negadv_insert_v1	partial	1	clause	The model can barely handle noise.
9	negadv_insert_v1	partial	1	clause	The model can rarely handle noise.
9	negadv_insert_v1	partial	1	clause	The model can seldom handle noise.
9	negadv_insert_v1	partial	1	clause	The model can scarcely handle noise.
9	hedge_wrap_v1	maybe_not	1	clause	The model can maybe not handle noise.
9	hedge_wrap_v1	possibly_not	1	clause	The model can possibly not handle noise.
9	hedge_wrap_v1	probably_not	1	clause	The model can probably not handle noise.
9	hedge_wrap_v1	might_not	1	clause	The model might not handle noise.
9	hedge_wrap_v1	may_not	1	clause	The model may not handle noise.
9	intensify_wrap_v1	surely_not	1	clause	The model can surely not handle noise.
9	intensify_wrap_v1	definitely_not	1	clause	The model can definitely not handle noise.
9	intensify_wrap_v1	certainly_not	1	clause	The model can certainly not handle noise.
9	intensify_wrap_v1	absolutely_not	1	clause	The model can absolutely not handle noise.
9	intensify_wrap_v1	by_no_means	1	clause	The model can by no means handle noise.
9	modal_reading_v1	cannot_ability_denied	1	clause	The model cannot handle noise.
9	modal_reading_v1	may_not_permission_denied	1	clause	The model may not handle noise.
10	syn_existing_aux_v1	existing_aux	1	clause	The parser must not handle noise.
10	modal_reading_v1	must_not_prohibition	1	clause	The parser must not handle noise.
10	modal_reading_v1	need_not_absence_of_obligation	1	clause	The parser need not handle noise.
11	syn_copula_v1	copula	1	clause	The task is not simple.
11	negadv_insert_v1	absolute	1	clause	The task is never simple.
11	negadv_insert_v1	partial	1	clause	The task is hardly simple.
11	negadv_insert_v1	partial	1	clause	The task is barely simple.
11	negadv_insert_v1	partial	1	clause	The task is rarely simple.
11	negadv_insert_v1	partial	1	clause	The task is seldom simple.
11	negadv_insert_v1	partial	1	clause	The task is scarcely simple.
11	antonym_wordnet_v1	antonym_adj	1	predicate	The task is complex.
11	hedge_wrap_v1	maybe_not	1	clause	The task is maybe not simple.
11	hedge_wrap_v1	possibly_not	1	clause	The task is possibly not simple.
11	hedge_wrap_v1	probably_not	1	clause	The task is probably not simple.
11	hedge_wrap_v1	might_not	1	clause	The task might not be simple.
11	hedge_wrap_v1	may_not	1	clause	The task may not be simple.
11	intensify_wrap_v1	surely_not	1	clause	The task is surely not simple.
11	intensify_wrap_v1	definitely_not	1	clause	The task is definitely not simple.
11	intensify_wrap_v1	certainly_not	1	clause	The task is certainly not simple.
11	intensify_wrap_v1	absolutely_not	1	clause	The task is absolutely not simple.
11	intensify_wrap_v1	not_at_all	1	clause	The task is not at all simple.
11	intensify_wrap_v1	by_no_means	1	clause	The task is by no means simple.
11	contrastive_frame_v1	anything_but	1	predicate	The task is anything but simple.
11	contrastive_frame_v1	far_from	1	predicate	The task is far from simple.
12	affirm_affixal_strip_v1	strip_prefix_im	0	predicate	The task is possible.
12	k1_lexical_cancel_v1	cancel_impossible	0	clause	The task is not impossible.
13	syn_copula_v1	copula	1	clause	The result is not important.
13	affix_derive_v1	prefix_un	1	predicate	The result is unimportant.
13	antonym_wordnet_v1	antonym_adj	1	predicate	The result is unimportant.
13	contrastive_frame_v1	anything_but	1	predicate	The result is anything but important.
13	contrastive_frame_v1	far_from	1	predicate	The result is far from important.
13	k1_affixal_cancel_v1	not_prefix_un	0	clause	The result is not unimportant.
14	syn_copula_v1	copula	1	clause	The result is not unimportant.
14	affirm_affixal_strip_v1	strip_prefix_un	0	predicate	The result is important.
14	contrastive_frame_v1	anything_but	1	predicate	The result is anything but unimportant.
14	contrastive_frame_v1	far_from	1	predicate	The result is far from unimportant.
15	syn_copula_v1	copula	1	clause	The check is not useful.
15	affix_derive_v1	suffix_less	1	predicate	The check is useless.
15	antonym_wordnet_v1	antonym_adj	1	predicate	The check is useless.
15	antonym_wordnet_v1	antonym_adj	1	predicate	The check is useless.
15	contrastive_frame_v1	anything_but	1	predicate	The check is anything but useful.
15	contrastive_frame_v1	far_from	1	predicate	The check is far from useful.
15	k1_affixal_cancel_v1	not_suffix_less	0	clause	The check is not useless.
16	syn_do_support_v1	do_support	1	clause	The system does not have redundancy.
16	implicit_lack_v1	lacks	1	predicate	The system lacks redundancy.
16	prep_privative_copula_v1	without	1	predicate	The system is without redundancy.
16	prep_privative_copula_v1	devoid_of	1	predicate	The system is devoid of redundancy.
16	prep_privative_copula_v1	free_of	1	predicate	The system is free of redundancy.
17	affirm_implicit_strip_v1	lacks_to_has	0	predicate	The system has redundancy.
17	k1_lexical_cancel_v1	cancel_lacks	0	clause	The system does not lack redundancy.
18	syn_do_support_v1	do_support	1	clause	The parser does not run with a cache.
18	prep_without_v1	without	1	predicate	The parser runs without a cache.
18	prep_without_v1	in_the_absence_of	1	predicate	The parser runs in the absence of a cache.
20	affirm_implicit_strip_v1	strip_to_inf	0	clause	The function sorts the array.
20	k1_lexical_cancel_v1	cancel_fails	0	clause	The function does not fail to sort the array.
21	affirm_implicit_strip_v1	strip_gerund	0	clause	He takes the money.
21	k1_lexical_cancel_v1	cancel_denies	0	clause	He does not deny taking the money.
22	syn_do_support_v1	do_support	1	clause	Some students did not solve the problem.
22	quant_swap_v1	some_to_no	1	subject	No students solved the problem.
23	syn_do_support_v1	do_support	1	clause	All the students did not pass the exam.
23	quant_swap_v1	all_to_none_of	1	subject	None of the students passed the exam.
23	antonym_wordnet_v1	antonym_verb	1	clause	All the students failed the exam.
23	scope_position_v1	subject_scope	1	subject	Not all the students passed the exam.
23	scope_position_v1	predicate_scope	1	predicate	All the students did not pass the exam.
24	syn_do_support_v1	do_support	1	clause	Everyone did not pass the exam.
24	quant_swap_v1	everyone_to_no_one	1	subject	No one passed the exam.
24	antonym_wordnet_v1	antonym_verb	1	clause	Everyone failed the exam.
24	scope_position_v1	subject_scope	1	subject	Not everyone passed the exam.
24	scope_position_v1	predicate_scope	1	predicate	Everyone did not pass the exam.
25	quant_swap_v1	everyone_to_no_one	1	subject	Not no one passed the exam.
25	antonym_wordnet_v1	antonym_verb	1	clause	Not everyone failed the exam.
25	rescope_subject_to_predicate_v1	subject_to_predicate_scope	1	predicate	Everyone did not pass the exam.
26	affirm_do_support_v1	collapse_do_support	0	clause	Everyone passed the exam.
26	quant_swap_v1	everyone_to_no_one	1	subject	No one did not pass the exam.
26	antonym_wordnet_v1	antonym_verb	1	clause	Everyone did not fail the exam.
26	rescope_predicate_to_subject_v1	predicate_to_subject_scope	1	subject	Not everyone passed the exam.
27	affirm_quantifier_flip_v1	no_to_some	0	subject	Some students passed.
27	antonym_wordnet_v1	antonym_verb	1	clause	No students failed.
28	affirm_quantifier_flip_v1	neither_to_both	0	subject	Both tests passed.
28	antonym_wordnet_v1	antonym_verb	1	clause	Neither test failed.
29	affirm_quantifier_flip_v1	no_to_someone	0	subject	Someone passed the exam.
29	antonym_wordnet_v1	antonym_verb	1	clause	No one failed the exam.
30	affirm_neg_adverb_v1	strip_rarely	0	clause	He arrives early.
30	affirm_neg_adverb_v1	rarely_to_often	0	clause	He often arrives early.
30	antonym_wordnet_v1	antonym_adv	1	predicate	He rarely arrives late.
31	affirm_neg_adverb_v1	strip_never	0	clause	He calls.
31	affirm_neg_adverb_v1	never_to_sometimes	0	clause	He sometimes calls.
32	affirm_do_support_v1	collapse_do_support	0	clause	The scheduler runs the process.
33	affirm_do_support_v1	collapse_do_support	0	clause	The kernel ran the job.
34	affirm_aux_neg_v1	drop_aux_negator	0	clause	The process can access the memory.
35	affirm_aux_neg_v1	drop_aux_negator	0	clause	The pages were loaded.
36	affirm_copula_neg_v1	drop_copula_negator	0	clause	Delhi is the capital of India.
37	affirm_do_support_v1	collapse_do_support	1	clause	The function fails to sort the array.
37	affirm_implicit_strip_v1	strip_to_inf	1	clause	The function does not sort the array.
38	affirm_affixal_strip_v1	strip_prefix_un	0	predicate	The protocol is reliable.
38	k1_lexical_cancel_v1	cancel_unreliable	0	clause	The protocol is not unreliable.
39	affirm_copula_neg_v1	drop_copula_negator	1	clause	It is unusual.
39	affirm_affixal_strip_v1	strip_prefix_un	1	predicate	It is not usual.
40	interrogative_negation_v1	question_post_subject	1	clause	Does it not compile?
40	interrogative_negation_v1	question_contracted	1	clause	Doesn't it compile?
41	affirm_affixal_strip_v1	strip_prefix_im	0	subject	Is the task possible?
41	interrogative_negation_v1	question_contracted	0	clause	Isn't the task impossible?
42	syn_copula_v1	copula	1	clause	There is not a solution.
42	contrastive_frame_v1	anything_but	1	predicate	There is anything but a solution.
42	contrastive_frame_v1	far_from	1	predicate	There is far from a solution.
42	contrastive_frame_v1	the_opposite_of	1	predicate	There is the opposite of a solution.
42	existential_no_v1	existential_no	1	predicate	There is no solution.
43	syn_copula_v1	copula	1	clause	This parser is not faster than the old one.
43	contrastive_frame_v1	anything_but	1	predicate	This parser is anything but faster than the old one.
43	contrastive_frame_v1	far_from	1	predicate	This parser is far from faster than the old one.
43	comparative_no_v1	no_comparative	1	predicate	This parser is no faster than the old one.
44	syn_do_support_v1	do_support	1	clause	If the test passes, the build does not succeed.
44	antonym_wordnet_v1	antonym_verb	1	predicate	If the test fails, the build succeeds.
44	k2_clause_pair_v1	do_support+do_support	2	clause	If the test does not pass, the build does not succeed.
44	clause_target_negation_v1	clause_do_support	1	clause	If the test does not pass, the build succeeds.
44	clause_target_negation_v1	clause_do_support	1	clause	If the test passes, the build does not succeed.
45	affirm_do_support_v1	collapse_do_support	0	clause	If the test passes, the build succeeds.
45	antonym_wordnet_v1	antonym_verb	1	predicate	If the test fails, the build does not succeed.
45	clause_target_negation_v1	clause_do_support	2	clause	If the test does not pass, the build does not succeed.
46	syn_do_support_v1	do_support	1	clause	The function does not sort the array and returns the result.
46	k2_clause_pair_v1	do_support+do_support	2	clause	The function does not sort the array and does not return the result.
46	clause_target_negation_v1	clause_do_support	1	clause	The function does not sort the array and returns the result.
46	clause_target_negation_v1	clause_do_support	1	clause	The function sorts the array and does not return the result.
47	syn_copula_v1	copula	1	clause	The result is not important and the method works.
47	affix_derive_v1	prefix_un	1	predicate	The result is unimportant and the method works.
47	antonym_wordnet_v1	antonym_adj	1	predicate	The result is unimportant and the method works.
47	contrastive_frame_v1	anything_but	1	predicate	The result is anything but important and the method works.
47	contrastive_frame_v1	far_from	1	predicate	The result is far from important and the method works.
47	k1_affixal_cancel_v1	not_prefix_un	0	clause	The result is not unimportant and the method works.
47	k2_clause_pair_v1	copula+do_support	2	clause	The result is not important and the method does not work.
47	k2_cross_clause_v1	not+prefix_un	2	clause	The result is unimportant and the method does not work.
47	clause_target_negation_v1	clause_copula	1	clause	The result is not important and the method works.
47	clause_target_negation_v1	clause_do_support	1	clause	The result is important and the method does not work.
48	syn_do_support_v1	do_support	1	clause	The parser that can handle noise does not sort the array.
48	k2_clause_pair_v1	existing_aux+do_support	2	clause	The parser that cannot handle noise does not sort the array.
48	clause_target_negation_v1	clause_existing_aux	1	clause	The parser that cannot handle noise sorts the array.
48	clause_target_negation_v1	clause_do_support	1	clause	The parser that can handle noise does not sort the array.
49	syn_copula_v1	copula	1	clause	What a mess this is not!
49	contrastive_frame_v1	anything_but	1	predicate	Anything but What a mess this is!
49	contrastive_frame_v1	far_from	1	predicate	Far from What a mess this is!
49	contrastive_frame_v1	the_opposite_of	1	predicate	The opposite of What a mess this is!
50	syn_do_support_v1	do_support	1	clause	The build does not seem stable.
50	affix_derive_v1	prefix_un	1	predicate	The build seems unstable.
50	antonym_wordnet_v1	antonym_adj	1	predicate	The build seems unstable.
50	k1_affixal_cancel_v1	not_prefix_un	0	clause	The build does not seem unstable.
51	affirm_do_support_v1	collapse_do_support	0	clause	The function probably sorts the array.
52	affirm_do_support_v1	collapse_do_support	0	clause	The function definitely sorts the array.
53	syn_copula_v1	copula	1	clause	The result is not anything but simple.
53	antonym_wordnet_v1	antonym_adj	1	predicate	The result is anything but complex.
53	contrastive_frame_v1	anything_but	1	predicate	The result is anything but anything but simple.
53	contrastive_frame_v1	far_from	1	predicate	The result is far from anything but simple.
53	contrastive_frame_v1	the_opposite_of	1	predicate	The result is the opposite of anything but simple.
54	affirm_neg_adverb_v1	strip_never	1	clause	The function fails to sort the array.
54	affirm_neg_adverb_v1	never_to_sometimes	1	clause	The function sometimes fails to sort the array.
54	affirm_implicit_strip_v1	strip_to_inf	1	clause	The function never sorts the array.
55	affirm_do_support_v1	collapse_do_support	1	clause	The function sorts the array and does not return the result.
56	affirm_copula_neg_v1	drop_copula_negator	1	clause	The task is impossible.
56	affirm_affixal_strip_v1	strip_prefix_im	1	predicate	The task is not possible.
"""
