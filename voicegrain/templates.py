"""Default prompt templates. Every job takes another template as an argument."""

# The TEMPLATE_ tokens each template may hold.
USEFUL_POST = (
    "Decide whether this post tells something lasting about its author. Reply as JSON with UsefulInformation, "
    "Justification and UserInformation.\nUser Name: TEMPLATE_USER_NAME\nPost: TEMPLATE_TWEET"
)
USEFUL_POSTS = (
    "Describe the author of these posts. Reply as JSON with UsefulInformation, Justification and UserInformation.\n"
    "User Name: TEMPLATE_USER_NAME\nTEMPLATE_USER_TWEETS"
)
MERGE_DESCRIPTIONS = (
    "Merge these descriptions of one user into a profile without repeats or contradictions. Reply as JSON with "
    "user_id and user_profile.\nUser ID: TEMPLATE_USER_ID\nDescriptions: TEMPLATE_USER_DESCRIPTION_LIST"
)
FICTIONAL_PROFILE = "Invent one person's interests and habits in a short paragraph."
INTEREST = (
    "Would this user be interested in the TEMPLATE_ITEM_TYPE below? Topic: TEMPLATE_TOPIC. Reply as JSON with "
    "Justification and IsInterested.\nUser Name: TEMPLATE_USER_NAME\nUser Profile: TEMPLATE_USER_PROFILE\n"
    "Item: TEMPLATE_ITEM_DESCRIPTION"
)
HISTORY = (
    "A user chose these TEMPLATE_TOPIC:\nTEMPLATE_USER_INTERACTIONS\nWould the user choose this one? YES or NO.\n"
    "TEMPLATE_CANDIDATE_ITEM"
)
PERSONAL_ANSWER = (
    "Rewrite the reference answer for this user.\nUser Profile: TEMPLATE_USER_PROFILE\nQuestion: TEMPLATE_QUESTION\n"
    "Reference Answer: TEMPLATE_REFERENCE_ANSWER"
)
QUESTION = "Answer the question.\nQuestion: TEMPLATE_QUESTION"
QUESTION_FOR_USER = (
    "Answer the question for this user.\nUser Name: TEMPLATE_USER_NAME\nUser Profile: TEMPLATE_USER_PROFILE\n"
    "Question: TEMPLATE_QUESTION"
)
PERSPECTIVE = (
    "Answer the question as this user would like it.\nUser Profile: TEMPLATE_USER_PROFILE\nQuestion: TEMPLATE_QUESTION"
)
SUMMARY = "Merge these answers into one.\nQuestion: TEMPLATE_QUESTION\nAnswers:\nTEMPLATE_ANSWERS"
GRADE_BY_REFERENCE = (
    "TEMPLATE_GRADING_CRITERIA\nQuestion: TEMPLATE_QUESTION\nReference: TEMPLATE_GPT4_ANSWER\nAnswer: TEMPLATE_TEST_ANSWER"
)
GRADE_BY_PROFILE = (
    "TEMPLATE_GRADING_CRITERIA\nQuestion: TEMPLATE_QUESTION\nUser Profile: TEMPLATE_USER_PROFILE\nAnswer: TEMPLATE_TEST_ANSWER"
)
AUTHOR = (
    "Did this user write the posts? Reply as JSON with Justification and IsFromUser.\nUser Name: TEMPLATE_USER_NAME\n"
    "User Profile: TEMPLATE_USER_PROFILE\nTEMPLATE_TWEETS"
)
PROFILE_QUESTION = (
    "Answer from the profile. Reply as JSON with Answer.\nUser Name: TEMPLATE_USER_NAME\n"
    "User Profile: TEMPLATE_USER_PROFILE\nQuestion: TEMPLATE_QUESTION"
)
RECOMMENDER_SYSTEM = "You recommend items. Reply with YES or NO only: would the user choose the candidate item?"
RECOMMENDER_USER = "What this person chose before:\n{history}\nWould they choose this next? {candidate}\n"
